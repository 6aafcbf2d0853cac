"""Node tables, edge tables and links through shared entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import materialize
from ..sources import sample_view
from .base import clip_sql, log1p, query, rounded, tidy, tx, with_tx

_SLOTS = "(select greatest(100, count(*) // 40) from tx)"


def hex_number(text: str, digits: int = 8) -> str:
    return f"cast(concat('0x', substring(sha256({text}), 1, {digits})) as bigint)"


IDS = (", g as (select *, sha256(concat('ip-', substring(account_id_hash, 1, 16), '-', "
       f"cast({hex_number('transaction_id')} % {_SLOTS} as varchar))) as ip_node_id, "
       "concat('mcc_', coalesce(merchant_category_code, 'UNKNOWN')) as merchant_node_id from tx)")


def with_graph(sql: str, names: list[str]) -> str:
    base = ["transaction_id", "account_id_hash", "merchant_category_code"]
    body = sample_view.duck_transactions(*base, *[n for n in names if n not in base])
    return f"with tx as (\n{body}\n){IDS}\n{sql}"


def graph_tx(spark, sf_dir):
    return graph.with_graph_ids(tx(spark, sf_dir))


@query("graph_ids", with_graph("select transaction_id, ip_node_id, merchant_node_id from g", []))
def _ids(spark, sf_dir):
    return graph_tx(spark, sf_dir).select("transaction_id", "ip_node_id", "merchant_node_id")


_ROLE = ("min(transaction_dt) as first_tx, max(transaction_dt) as last_tx, count(transaction_id) as lifetime_tx_count, "
         "sum(amount_inr) as lifetime_amount, max(label_is_fraud) as node_label")


def _mode_sql(key: str) -> str:
    return (f"(select {key} as k, label_source from (select {key}, label_source, row_number() over "
            f"(partition by {key} order by count(*) desc, label_source) as rn from tx where {key} is not null "
            f"group by 1, 2) as z where rn = 1)")


_ACCOUNT_NAMES = ["transaction_id", "account_id_hash", "beneficiary_id_hash", "transaction_dt", "amount_inr",
                  "label_is_fraud", "label_source", "days_since_account_open", "beneficiary_sar_count",
                  "second_hop_sar_count", "typical_velocity_daily", "amount_mean_90d", "ip_reputation_score",
                  "watchlist_hit", "synthetic_identity_score", "distinct_devices_30d", "failed_auth_count_7d"]

_ROLES = f"""roles as (
  select s.*, m.label_source from (
    select account_id_hash as node_id, {_ROLE}, median(days_since_account_open) as account_age_days,
      max(beneficiary_sar_count) as prior_sar_count, max(second_hop_sar_count) as prior_alert_count,
      max(label_is_fraud) as prior_confirmed_fraud, avg(typical_velocity_daily) as monthly_avg_tx_count,
      avg(amount_mean_90d) as monthly_avg_amount, avg(ip_reputation_score) as geographic_risk_score,
      max(cast(watchlist_hit as int)) as pep_flag, avg(synthetic_identity_score) as industry_risk_score,
      max(distinct_devices_30d) as distinct_devices_90d, avg(failed_auth_count_7d) as avg_failed_auth_monthly
    from tx group by 1) s join {_mode_sql('account_id_hash')} m on s.node_id = m.k
  union all by name
  select b.*, m.label_source from (select beneficiary_id_hash as node_id, {_ROLE} from tx group by 1) b
    join {_mode_sql('beneficiary_id_hash')} m on b.node_id = m.k
)"""

_ACCOUNT_SQL = f""", {_ROLES}, role_mode as (
  select node_id as k, label_source from (select node_id, label_source, row_number() over
    (partition by node_id order by count(*) desc, label_source) as rn from roles group by 1, 2) as z where rn = 1
), merged as (
  select node_id, min(first_tx) as first_tx, max(last_tx) as last_tx,
    least(greatest(coalesce(median(account_age_days), 365e0), 0e0), 36500e0) as age,
    sum(lifetime_tx_count)::bigint as n, sum(lifetime_amount) as amount, max(prior_sar_count) as sar,
    max(prior_alert_count) as alerts, max(prior_confirmed_fraud) as confirmed, avg(monthly_avg_tx_count) as mtx,
    avg(monthly_avg_amount) as mamt, avg(geographic_risk_score) as geo, max(pep_flag) as pep,
    avg(industry_risk_score) as industry, max(distinct_devices_90d) as devices,
    avg(avg_failed_auth_monthly) as auth, max(node_label) as node_label
  from roles group by 1
)
select node_id, age as account_age_days, (case when age > 730 then 3 when age > 90 then 2 else 1 end)::bigint as kyc_tier,
  (case when {log1p('coalesce(mamt, amount / 12e0)')} > 12.5 then 1 else 0 end)::bigint as account_type,
  least(age / 365e0, 100e0) as relationship_years, n as lifetime_tx_count, {log1p('amount')} as lifetime_amount_log,
  least(coalesce(sar, 0), 127)::double as prior_sar_count, least(coalesce(alerts, 0), 32767)::double as prior_alert_count,
  coalesce(confirmed, 0)::bigint as prior_confirmed_fraud, coalesce(mtx, n / 12e0) as monthly_avg_tx_count,
  {log1p('coalesce(mamt, amount / 12e0)')} as monthly_avg_amount_log,
  least(greatest(coalesce(geo, 0.1e0), 0e0), 1e0) as geographic_risk_score, coalesce(pep, 0)::bigint as pep_flag,
  least(greatest(coalesce(industry, 0e0), 0e0), 1e0) as industry_risk_score,
  least(coalesce(devices, 1), 10000)::double as distinct_devices_90d,
  least(coalesce(auth, 0e0), 10000e0) as avg_failed_auth_monthly, (case when age < 90 then 1 else 0 end)::bigint as is_new_account,
  coalesce(node_label, 0)::bigint as node_label, label_source, epoch_us(first_tx) as first_tx, epoch_us(last_tx) as last_tx
from merged join role_mode on node_id = k"""

ACCOUNT_DOUBLES = ["account_age_days", "relationship_years", "lifetime_amount_log", "prior_sar_count",
                   "prior_alert_count", "monthly_avg_tx_count", "monthly_avg_amount_log", "geographic_risk_score",
                   "industry_risk_score", "distinct_devices_90d", "avg_failed_auth_monthly"]


def account_sql() -> str:
    return rounded(with_tx("", *_ACCOUNT_NAMES).rstrip() + _ACCOUNT_SQL, *ACCOUNT_DOUBLES)


def account_tx(spark, sf_dir):
    """What account nodes are made of, stored: it is read several times."""
    return materialize(tx(spark, sf_dir).select(*_ACCOUNT_NAMES), "transactions")


@query("node_accounts", account_sql())
def accounts(spark, sf_dir):
    return tidy(graph.account_nodes(account_tx(spark, sf_dir)))


@query("node_account_roles", rounded(with_tx("", *_ACCOUNT_NAMES).rstrip() + f", {_ROLES}\n" +
       "select * replace (epoch_us(first_tx) as first_tx, epoch_us(last_tx) as last_tx, "
       "cast(node_label as bigint) as node_label, cast(prior_sar_count as bigint) as prior_sar_count, "
       "cast(prior_alert_count as bigint) as prior_alert_count, cast(pep_flag as bigint) as pep_flag, "
       "cast(prior_confirmed_fraud as bigint) as prior_confirmed_fraud, "
       "cast(distinct_devices_90d as bigint) as distinct_devices_90d, round(lifetime_amount, 2) as lifetime_amount) from roles",
       "account_age_days", "monthly_avg_tx_count", "monthly_avg_amount", "geographic_risk_score",
       "industry_risk_score", "avg_failed_auth_monthly"))
def _roles(spark, sf_dir):
    roles = graph.account_roles(account_tx(spark, sf_dir))
    return tidy(roles.withColumn("lifetime_amount", F.round("lifetime_amount", 2)))


@query("node_devices", rounded(with_tx(
    "select device_fingerprint_hash as node_id, cast(floor(greatest((epoch_us((select max(transaction_dt) from tx)) "
    "- epoch_us(min(transaction_dt))) / 1e6 / 86400, 0)) as bigint) as first_seen_days_ago, "
    "count(distinct account_id_hash) as associated_account_count, "
    f"{hex_number('device_fingerprint_hash')} % 4 as platform, "
    f"{clip_sql('avg(behavioural_drift_score)', '0e0', '1e0')} as device_risk_score, "
    "max(cast(is_tor_vpn_proxy as bigint)) as has_root_jailbreak from tx where device_fingerprint_hash is not null group by 1",
    "device_fingerprint_hash", "transaction_dt", "account_id_hash", "behavioural_drift_score", "is_tor_vpn_proxy"),
    "device_risk_score"))
def devices(spark, sf_dir):
    return tidy(graph.device_nodes(tx(spark, sf_dir)))


@query("node_ips", rounded(with_graph(
    f"select ip_node_id as node_id, {clip_sql('avg(ip_reputation_score)', '0e0', '1e0')} as reputation_score, "
    "max(cast(is_tor_vpn_proxy as bigint)) as is_tor, max(cast(is_tor_vpn_proxy as bigint)) as is_vpn, "
    "max(cast(is_tor_vpn_proxy as bigint)) as is_proxy, avg(cast(geo_country_mismatch as int)) as country_risk_score, "
    "count(distinct account_id_hash) as associated_account_count from g group by 1",
    ["ip_reputation_score", "is_tor_vpn_proxy", "geo_country_mismatch"]), "reputation_score", "country_risk_score"))
def ips(spark, sf_dir):
    return tidy(graph.ip_nodes(graph_tx(spark, sf_dir)))


@query("node_merchants", rounded(with_graph(
    "select merchant_node_id as node_id, merchant_category_code as mcc_code, "
    f"30 + {hex_number('merchant_node_id')} % 3650 as merchant_age_days, "
    "(select avg(label_is_fraud) from g g2 where g2.merchant_node_id = g.merchant_node_id) as mcc_risk_score, "
    "avg(label_is_fraud) as chargeback_rate_90d, least(sum(second_hop_sar_count), 32767)::bigint as dispute_count_90d "
    "from g where merchant_category_code is not null group by 1, 2", ["label_is_fraud", "second_hop_sar_count"]),
    "mcc_risk_score", "chargeback_rate_90d"))
def merchants(spark, sf_dir):
    return tidy(graph.merchant_nodes(graph_tx(spark, sf_dir)))


_NOW = "epoch_us((select max(transaction_dt) from {t}))"
_PAIR = "account_id_hash as src_node_id, {d} as dst_node_id"


def _hours(t="tx"):
    return f"greatest(({_NOW.format(t=t)} - epoch_us(max(transaction_dt))) / 1e6 / 3600, 0)"


@query("edge_transfers", rounded(with_tx(
    f"select {_PAIR.format(d='beneficiary_id_hash')}, count(*) as transaction_count_30d, "
    f"{log1p('sum(amount_inr)')} as total_amount_30d_log, "
    f"greatest(({_NOW.format(t='tx')} - epoch_us(min(transaction_dt))) / 1e6 / 86400, 0) as first_transaction_days_ago, "
    f"{_hours()} as last_transaction_hours_ago, {log1p('avg(amount_inr)')} as avg_amount_log, "
    "(case when count(*) >= 2 then 1 else 0 end)::bigint as is_recurring, avg(label_is_fraud) as edge_risk_score "
    "from tx group by 1, 2", "account_id_hash", "beneficiary_id_hash", "amount_inr", "transaction_dt", "label_is_fraud"),
    "total_amount_30d_log", "first_transaction_days_ago", "last_transaction_hours_ago", "avg_amount_log",
    "edge_risk_score"))
def transfers(spark, sf_dir):
    return tidy(graph.transfer_edges(tx(spark, sf_dir)))


@query("edge_devices", rounded(with_tx(
    "select *, case when row_number() over (partition by src_node_id order by session_count_30d desc, dst_node_id) = 1 "
    "then 1 else 0 end as is_primary_device from ("
    f"select {_PAIR.format(d='device_fingerprint_hash')}, count(*) as session_count_30d, {_hours()} as last_session_hours_ago "
    "from tx where device_fingerprint_hash is not null group by 1, 2) as e",
    "account_id_hash", "device_fingerprint_hash", "transaction_dt"), "last_session_hours_ago"))
def device_edges(spark, sf_dir):
    return tidy(graph.device_edges(tx(spark, sf_dir)))


@query("edge_ips", rounded(with_graph(
    f"select {_PAIR.format(d='ip_node_id')}, count(*) as session_count_7d, {_hours('g')} as last_session_hours_ago "
    "from g group by 1, 2", ["transaction_dt"]), "last_session_hours_ago"))
def ip_edges(spark, sf_dir):
    return tidy(graph.ip_edges(graph_tx(spark, sf_dir)))


@query("edge_merchants", rounded(with_graph(
    f"select {_PAIR.format(d='merchant_node_id')}, count(*) as transaction_count_90d, "
    f"{log1p('sum(amount_inr)')} as total_amount_90d_log, (case when count(*) = 1 then 1 else 0 end)::bigint "
    "as is_first_transaction from g group by 1, 2", ["amount_inr"]), "total_amount_90d_log"))
def merchant_edges(spark, sf_dir):
    return tidy(graph.merchant_edges(graph_tx(spark, sf_dir)))


def chain_sql(key: str, relation: str, cap: int | None, length: int | None) -> str:
    first = "" if length is None else f"where rn <= {length}"
    limit = "" if cap is None else f"order by shared_entity_id, rn limit {cap}"
    return (f"select src_node_id, dst_node_id, '{relation}' as relation, shared_entity_id from (select src_node_id, "
            "lead(src_node_id) over (partition by d order by src_node_id) as dst_node_id, d as shared_entity_id, rn "
            "from (select a as src_node_id, d, row_number() over (partition by d order by a) as rn from "
            f"(select distinct account_id_hash as a, {key} as d from g where {key} is not null) as x) as y "
            f"{first}) as z where dst_node_id is not null {limit}")


def derived_sql(max_edges: int | None = None, length: int | None = None) -> str:
    cap = None if max_edges is None else max(1, max_edges // 3)
    return "select distinct * from (" + " union all ".join(
        f"select * from ({chain_sql(k, r, cap, length)}) as c{i}" for i, (k, r) in enumerate([
            ("device_fingerprint_hash", "SHARES_DEVICE"), ("ip_node_id", "SHARES_IP"),
            ("merchant_node_id", "SHARES_MERCHANT")])) + ") as u"


def derived(spark, sf_dir, max_edges=None, length=None):
    df = materialize(graph_tx(spark, sf_dir).select(
        "transaction_id", "account_id_hash", "device_fingerprint_hash", "transaction_dt", "amount_inr", "ip_node_id",
        "merchant_node_id"), "transactions")
    return graph.shared_entity_edges(graph.device_edges(df), graph.ip_edges(df), graph.merchant_edges(df), max_edges, length)


@query("edge_shared_entities", with_graph(derived_sql(), ["device_fingerprint_hash"]))
def _derived(spark, sf_dir):
    return derived(spark, sf_dir)


@query("edge_shared_entities_capped", with_graph(derived_sql(900, graph.CHAIN_LENGTH), ["device_fingerprint_hash"]))
def _derived_capped(spark, sf_dir):
    return derived(spark, sf_dir, 900, graph.CHAIN_LENGTH)


# what the tables of the graph are made of
GRAPH_NAMES = sorted({*_ACCOUNT_NAMES, "device_fingerprint_hash", "merchant_category_code", "behavioural_drift_score",
                      "is_tor_vpn_proxy", "geo_country_mismatch"})


@query("graph_counts", with_graph(f"""select 'transactions' as "table", count(*) as "rows" from g
union all select 'account_nodes', (select count(distinct n) from (select account_id_hash as n from g union all select beneficiary_id_hash from g) as u)
union all select 'device_nodes', count(distinct device_fingerprint_hash) from g
union all select 'ip_nodes', count(distinct ip_node_id) from g
union all select 'merchant_nodes', count(distinct merchant_category_code) from g
union all select 'account_account_edges', (select count(*) from (select distinct account_id_hash, beneficiary_id_hash from g) as e)
union all select 'derived_account_edges', (select count(*) from ({derived_sql()}) as d)""",
    ["beneficiary_id_hash", "device_fingerprint_hash"]))
def _counts(spark, sf_dir):
    df = materialize(tx(spark, sf_dir).select(*GRAPH_NAMES), "transactions")
    tables = graph.build_graph(df)
    names = ["account_nodes", "device_nodes", "ip_nodes", "merchant_nodes", "account_account_edges",
             "derived_account_edges"]
    out = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("transactions").alias("table"), "rows")
    for name in names:
        out = out.unionByName(tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return out
