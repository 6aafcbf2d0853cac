"""Imputation, features, weights, graph modes, injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..operators import features, inject
from ..sources import sample_view
from .base import clip_sql, log1p, query, round_sql, rounded, tidy, tx, with_tx

_DOUBLES = [c.name for c in schema.TRANSACTION if c.kind == "double"]
_BOOLS = schema.boolean_columns()

IMPUTED = "select * replace (" + ", ".join(
    [f"coalesce({n}, {float(v)!r}e0) as {n}" if n in _DOUBLES else f"coalesce({n}, {v}) as {n}"
     for n, v in schema.NULL_DEFAULTS.items()]
    + [f"coalesce({n}, false) as {n}" for n in _BOOLS]) + ") from tx"

_RAW = ["velocity_1h", "velocity_6h", "velocity_24h", "velocity_7d", "is_international", "geo_country_mismatch",
        "is_tor_vpn_proxy", "ip_reputation_score", "failed_auth_count_7d", "distinct_devices_30d",
        "behavioural_drift_score", "is_dormant_account", "is_new_beneficiary", "peer_amount_percentile",
        "watchlist_hit", "beneficiary_sar_count", "second_hop_sar_count", "mule_network_probability",
        "synthetic_identity_score", "rapid_fan_out_flag", "originator_graph_centrality"]

FEATURE_SQL = {
    "amount_inr_log": log1p("amount_inr"),
    "amount_usd_equiv_log": log1p("amount_usd_equiv"),
    "amount_zscore": clip_sql("(amount_inr - amount_mean_90d) / "
                              "(case when amount_std_90d = 0 then 1e0 else amount_std_90d end)", "-10e0", "10e0"),
    "amount_sum_1h_log": log1p("amount_sum_1h"),
    "amount_sum_24h_log": log1p("amount_sum_24h"),
    "ctr_proximity": clip_sql("1e0 - abs(amount_inr - 1000000e0) / 1000000e0", "0e0", "1e0"),
    "velocity_ratio_1h_24h": clip_sql(
        "velocity_1h / (case when velocity_24h = 0 then 0.001e0 else velocity_24h / 24e0 end)", "0e0", "1000e0"),
    "amount_per_tx_1h": log1p("amount_sum_1h / (case when velocity_1h = 0 then 1e0 else velocity_1h end)"),
    "distinct_bene_6h": "distinct_beneficiaries_6h",
    "distinct_bene_24h": "distinct_beneficiaries_24h",
    "hour_of_day": "hour(transaction_dt)",
    "day_of_week": "isodow(transaction_dt) - 1",
    "is_weekend": "case when isodow(transaction_dt) >= 6 then 1 else 0 end",
    "is_nighttime": "case when hour(transaction_dt) < 6 or hour(transaction_dt) >= 22 then 1 else 0 end",
    "is_month_end": "case when day(transaction_dt) >= 28 then 1 else 0 end",
    **{f"channel_{c}": f"case when channel = '{c}' then 1 else 0 end" for c in schema.MODEL_CHANNELS},
    "geo_distance_km_log": log1p("geo_distance_km"),
    "velocity_vs_baseline": clip_sql(
        "velocity_1h / (case when typical_velocity_daily = 0 then 0.001e0 else typical_velocity_daily / 24e0 end)",
        "0e0", "500e0"),
    "days_since_acct_open_log": log1p("days_since_account_open"),
    "shared_device_accounts_log": log1p("shared_device_accounts"),
    "shared_ip_accounts_log": log1p("shared_ip_accounts"),
    **{n: n for n in _RAW},
}


def feature_sql(names=schema.FEATURES, keep=("transaction_id",), source="tx") -> str:
    made = ", ".join(f"{round_sql(FEATURE_SQL[n])} as {n}" for n in names)
    return f"select {', '.join(keep)}, {made} from ({IMPUTED.replace('from tx', 'from ' + source)}) as im"


_GROUPS = {
    "feat_amount": schema.FEATURES[0:6],
    "feat_velocity": schema.FEATURES[6:14] + ["velocity_vs_baseline"],
    "feat_calendar": schema.FEATURES[14:19],
    "feat_channel": schema.FEATURES[19:25],
    "feat_geo_device": schema.FEATURES[25:31],
    "feat_behaviour": schema.FEATURES[32:38],
    "feat_graph": schema.FEATURES[38:46],
}

for _name, _columns in _GROUPS.items():
    def _group(spark, sf_dir, columns=tuple(_columns)):
        return tidy(features.transform(tx(spark, sf_dir), ["transaction_id"]).select("transaction_id", *columns))
    query(_name, with_tx(feature_sql(_columns)))(_group)


@query("impute", rounded(with_tx(
    "select transaction_id, " + ", ".join([*schema.NULL_DEFAULTS, *_BOOLS]) + f" from ({IMPUTED}) as im"),
    *[n for n in schema.NULL_DEFAULTS if n in _DOUBLES]))
def _impute(spark, sf_dir):
    return tidy(features.impute(tx(spark, sf_dir)).select("transaction_id", *schema.NULL_DEFAULTS, *_BOOLS))


@query("feat_engineered_table", with_tx(
    feature_sql(keep=("transaction_id", "cast(label_is_fraud as bigint) as label_is_fraud"))))
def engineered(spark, sf_dir):
    return tidy(features.engineered_table(tx(spark, sf_dir)))


_WEIGHT = ("(case label_is_fraud when 1 then 2.33e0 else 1e0 end) * (case label_source when 'CONFIRMED_SAR' then 1.5e0 "
           "when 'INVESTIGATOR' then 1.2e0 when 'CARD_NETWORK' then 1.1e0 when 'NPCI' then 1.1e0 "
           "when 'CONSORTIUM' then 0.9e0 when 'SYNTHETIC' then 0.7e0 else 1e0 end) * coalesce(label_confidence, 1e0)")


@query("sample_weights", with_tx(
    f"select transaction_id, {round_sql(f'({_WEIGHT}) / (select avg({_WEIGHT}) from tx)')} as sample_weight from tx",
    "transaction_id", "label_is_fraud", "label_source", "label_confidence"))
def _weights(spark, sf_dir):
    return tidy(features.sample_weights(tx(spark, sf_dir)).select("transaction_id", "sample_weight"))


@query("graph_mode_none", with_tx(
    "select transaction_id, 0::bigint as shared_device_accounts, 0::bigint as shared_ip_accounts, "
    "0::bigint as beneficiary_sar_count, 0::bigint as second_hop_sar_count, 0e0 as mule_network_probability, "
    "0e0 as synthetic_identity_score, false as rapid_fan_out_flag, 0e0 as originator_graph_centrality from tx",
    "transaction_id"))
def _none(spark, sf_dir):
    out = features.apply_graph_mode(tx(spark, sf_dir), "none")
    return tidy(out.select("transaction_id", *schema.GRAPH_COLUMNS))


_GRAPH_SELECT = ", ".join(
    f"cast({n} as bigint) as {n}" if n.endswith(("accounts", "count")) else
    (f"{round_sql(n)} as {n}" if n != "rapid_fan_out_flag" else n) for n in schema.GRAPH_COLUMNS)


@query("graph_mode_synthetic", with_tx(f"select transaction_id, {_GRAPH_SELECT} from tx",
                                       "transaction_id", *schema.GRAPH_COLUMNS))
def _synthetic(spark, sf_dir):
    out = features.apply_graph_mode(tx(spark, sf_dir), "synthetic")
    return tidy(out.select("transaction_id", *schema.GRAPH_COLUMNS))


INJECTED = """, scores as (
%s
), p as (
  select tx.*, coalesce(s.gnn_fraud_probability, 0e0) as p from tx left join (
    select account_id_hash as a, max(gnn_fraud_probability) as gnn_fraud_probability from scores group by 1) s
  on tx.account_id_hash = s.a
)""" % sample_view.DUCK_SCORES

_INJECT = """select transaction_id,
  round_even(p, 4) as mule_network_probability,
  round_even(least(greatest(originator_graph_centrality, sqrt(p) * 0.85e0), 1e0), 4) as originator_graph_centrality,
  round_even(least(greatest(synthetic_identity_score, p * 0.72e0), 1e0), 4) as synthetic_identity_score,
  cast(greatest(second_hop_sar_count, round_even(p * 8, 0)) as bigint) as second_hop_sar_count,
  rapid_fan_out_flag or p >= 0.72e0 as rapid_fan_out_flag
from p"""


def _with_scores(sql):
    body = sample_view.duck_transactions("transaction_id", "account_id_hash", *schema.GRAPH_COLUMNS)
    return f"with tx as (\n{body}\n){INJECTED}\n{sql}"


@query("inject_scores", rounded(_with_scores(_INJECT), "mule_network_probability",
                                "originator_graph_centrality", "synthetic_identity_score"))
def injected(spark, sf_dir):
    out = inject.inject_scores(tx(spark, sf_dir), sample_view.account_scores(spark, sf_dir))
    return tidy(out.select("transaction_id", "mule_network_probability", "originator_graph_centrality",
                           "synthetic_identity_score", "second_hop_sar_count", "rapid_fan_out_flag"))


@query("inject_mode_gnn_scores", rounded(_with_scores(
    _INJECT.replace("select transaction_id,", "select transaction_id, cast(shared_device_accounts as bigint) as shared_device_accounts,")),
    "mule_network_probability", "originator_graph_centrality", "synthetic_identity_score"))
def _mode_scores(spark, sf_dir):
    out = features.apply_graph_mode(tx(spark, sf_dir), "gnn_scores", sample_view.account_scores(spark, sf_dir))
    return tidy(out.select("transaction_id", "shared_device_accounts", "mule_network_probability",
                           "originator_graph_centrality", "synthetic_identity_score", "second_hop_sar_count",
                           "rapid_fan_out_flag"))


@query("inject_summary", _with_scores(
    'select count(*) as "rows", round(avg(p) + 1e-10, 6) as mean_injected_probability, '
    "round(max(p) + 1e-10, 6) as max_injected_probability from p"))
def _inject_summary(spark, sf_dir):
    out = inject.inject_scores(tx(spark, sf_dir), sample_view.account_scores(spark, sf_dir), keep_probability=True)
    return tidy(inject.injection_summary(out))


@query("graph_findings", with_tx(
    "select transaction_id, cast(shared_device_accounts as bigint) as shared_device_accounts, "
    "cast(beneficiary_sar_count as bigint) as beneficiary_sar_count, "
    "round(mule_network_probability + 1e-10, 6) as mule_network_probability, rapid_fan_out_flag, 8::bigint as fields from tx",
    "transaction_id", "shared_device_accounts", "beneficiary_sar_count", "mule_network_probability",
    "rapid_fan_out_flag"))
def _findings(spark, sf_dir):
    df = tx(spark, sf_dir)
    out = df.select("transaction_id", features.graph_findings(df).alias("f"))
    fields = len(out.schema["f"].dataType.fields)
    return tidy(out.select("transaction_id", "f.shared_device_accounts", "f.beneficiary_sar_count",
                           "f.mule_network_probability", "f.rapid_fan_out_flag",
                           F.lit(fields).cast("bigint").alias("fields")))
