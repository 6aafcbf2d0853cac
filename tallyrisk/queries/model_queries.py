"""Splits, metrics, gates, score responses and contributions over fixed score columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import typology_code, typology_name
from ..operators import explain, features, metrics, positions
from ..sources import sample_view
from ..session import materialize
from .quality_queries import _bad as bad_rows, defective
from .base import query, round_sql, rounded, tidy, tx, with_tx
from .feature_queries import feature_sql

# ---- splits -----------------------------------------------------------------------------

_ORDER = ("select transaction_id, label_is_fraud, row_number() over (order by transaction_dt, transaction_id) - 1 as i, "
          "count(*) over () as n from tx")


def _split_case(i="i", n="n"):
    end = f"cast(floor({n} * (1 - 0.1e0)) as bigint)"
    return (f"case when {i} < floor({end} * (1 - 0.1e0 / 0.9e0)) then 'train' when {i} < {end} then 'val' else 'test' end")


_SPLIT = f"select transaction_id, label_is_fraud, {_split_case()} as split from ({_ORDER}) as o"
_SPLIT_NAMES = ("transaction_id", "transaction_dt", "label_is_fraud")


@query("split_temporal", with_tx(f"select transaction_id, split from ({_SPLIT}) as s", *_SPLIT_NAMES))
def _temporal(spark, sf_dir):
    return positions.temporal_split(tx(spark, sf_dir)).select("transaction_id", "split")


@query("split_temporal_refined", with_tx(f"select transaction_id, split from ({_SPLIT}) as s", *_SPLIT_NAMES))
def _temporal_refined(spark, sf_dir):
    # a small fetch limit forces the search through all its levels
    return positions.temporal_split(tx(spark, sf_dir), fetch=2).select("transaction_id", "split")


@query("split_statistics", with_tx(
    f"select split, count(*) as n_total, sum(label_is_fraud)::bigint as n_fraud, {round_sql('avg(label_is_fraud)')} as fraud_rate "
    f"from ({_SPLIT}) as s group by 1", *_SPLIT_NAMES))
def _stats(spark, sf_dir):
    return tidy(positions.split_statistics(positions.temporal_split(tx(spark, sf_dir))))


@query("split_stratified", with_tx(
    f"select transaction_id, {_split_case()} as split from (select transaction_id, row_number() over (partition by label_is_fraud "
    "order by cast(concat('0x', substring(sha256(concat('42|', transaction_id)), 1, 12)) as bigint), transaction_id) - 1 as i, "
    "count(*) over (partition by label_is_fraud) as n from tx) as o", "transaction_id", "label_is_fraud"))
def _stratified(spark, sf_dir):
    return positions.stratified_split(tx(spark, sf_dir)).select("transaction_id", "split")


@query("split_account_grouped", with_tx(
    f"select transaction_id, arg_max(split, (transaction_dt, transaction_id)) over (partition by account_id_hash) as split from ("
    f"select tx.*, s.split from tx join ({_SPLIT}) as s using (transaction_id)) as q",
    "transaction_id", "transaction_dt", "label_is_fraud", "account_id_hash"))
def _grouped(spark, sf_dir):
    df = tx(spark, sf_dir).select("transaction_id", "transaction_dt", "account_id_hash")
    return positions.account_grouped_split(df).select("transaction_id", "split")


# ---- metrics over a fixed score column --------------------------------------------------

_SCORE = "round(least(1e0, amount_inr / 1.5e6), 2)"
_SCORED = (f"select transaction_id as id, label_is_fraud as label, {_SCORE} as probability, "
           "case when substring(transaction_id, 1, 1) in ('1', '2', '3') then 'val' else 'test' end as split from tx")
_SCORED_NAMES = ("transaction_id", "label_is_fraud", "amount_inr")


def scored(spark, sf_dir):
    return tx(spark, sf_dir).selectExpr(
        "transaction_id as id", "label_is_fraud as label", f"{_SCORE} as probability",
        "case when substring(transaction_id, 1, 1) in ('1', '2', '3') then 'val' else 'test' end as split")


METRIC_CTE = """, sc as (
  %s
), lv as (select split, probability, sum(label)::double as pos, (count(*) - sum(label))::double as neg from sc group by 1, 2
), cm as (select *, sum(neg) over (partition by split order by probability) - neg as below,
  sum(pos) over (partition by split order by probability desc) as tpos,
  sum(pos + neg) over (partition by split order by probability desc) as tall from lv
), rk as (select split, sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)) as auc,
  sum(pos * tpos / tall) / sum(pos) as pr_auc from cm group by 1
), th as (select split, sum((probability >= 0.5 and label = 1)::int)::double as tp, sum((probability >= 0.5 and label = 0)::int)::double as fp,
  sum((probability < 0.5 and label = 1)::int)::double as fn, sum((probability < 0.5 and label = 0)::int)::double as tn,
  avg((probability - label) ** 2) as brier, avg(label) as fraud_rate from sc group by 1
), bn as (select split, b, count(*) as n, avg(probability) as p, avg(label) as y from (select sc.*, e.b from sc left join
  (select i::int as b, i * 0.1e0 as lo, case when i = 9 then 1e0 else (i + 1) * 0.1e0 end as hi from range(10) as r(i)) e
  on probability >= lo and probability < hi) as z group by 1, 2
), ec as (select split, sum(case when b is not null then n * abs(p - y) else 0 end) / sum(n) as ece from bn group by 1
), mt as (select th.split, 2 * tp / (2 * tp + fp + fn) as f1_binary,
  (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 as f1_macro, tp / (tp + fp) as "precision", tp / (tp + fn) as recall,
  fp / (fp + tn) as fp_rate, brier, fraud_rate, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, auc, pr_auc, ece
  from th join rk on th.split = rk.split join ec on th.split = ec.split)""" % _SCORED


def _metric(sql, *doubles):
    return rounded(with_tx("", *_SCORED_NAMES).rstrip() + METRIC_CTE + "\n" + sql, *doubles)


_ALL = ["f1_binary", "f1_macro", '"precision"', "recall", "fp_rate", "brier", "fraud_rate", "auc", "pr_auc", "ece"]


@query("metric_all", _metric("select * from mt", *_ALL))
def _metrics(spark, sf_dir):
    return tidy(metrics.evaluate(scored(spark, sf_dir), ["split"]))


@query("metric_rank", _metric("select * from rk", "auc", "pr_auc"))
def _rank(spark, sf_dir):
    return tidy(metrics.rank_metrics(scored(spark, sf_dir), ["split"]))


@query("metric_calibration_error", _metric("select * from ec", "ece"))
def _ece(spark, sf_dir):
    return tidy(metrics.calibration_error(scored(spark, sf_dir), ["split"]))


@query("metric_gates", _metric(
    "select split, metric, op, threshold, value, passed, bool_and(passed) over (partition by split) as all_passed from (" +
    " union all ".join(f"select split, '{m}' as metric, '{op}' as op, {t}e0 as threshold, round({m}, 6) as value, {m} {op} {t} as passed from mt"
                       for m, op, t in schema.DEPLOYMENT_GATES) + ") as g", "threshold"))
def _gates(spark, sf_dir):
    return tidy(metrics.gates(metrics.evaluate(scored(spark, sf_dir), ["split"])))


# ---- score responses --------------------------------------------------------------------

_P = "((l_n * 31) % 10007) / 10006e0"


def _probability(spark, sf_dir):
    # p and raw p derived from the id by hash, so both engines hold the same doubles
    return tx(spark, sf_dir).select("transaction_id").withColumn(
        "_h", F.conv(F.substring(F.sha2("transaction_id", 256), 1, 8), 16, 10).cast("bigint")).select(
        "transaction_id", (F.col("_h") % 100003 / 100002.0).alias("probability"),
        (F.col("_h") % 99991 / 99990.0).alias("raw_probability"))


_H = "cast(concat('0x', substring(sha256(transaction_id), 1, 8)) as bigint)"
_PR = f"select transaction_id, ({_H} % 100003) / 100002e0 as p, ({_H} % 99991) / 99990e0 as r from tx"


@query("score_response", with_tx(
    "select transaction_id, round_even(p, 6) as probability, round_even(p * 100, 2) as probability_percentage, "
    "round_even(r, 6) as raw_model_probability, round_even(r * 100, 2) as raw_model_probability_percentage, "
    f"cast(round_even(p * 100, 0) as bigint) as risk_score, 0.5e0 as classification_threshold, p >= 0.5 as is_fraud from ({_PR}) as q",
    "transaction_id"))
def _response(spark, sf_dir):
    return tidy(explain.score_response(_probability(spark, sf_dir)))


@query("score_response_legacy", with_tx(
    "select transaction_id, round_even(p, 4) as probability, cast(floor(p * 100) as bigint) as risk_score, "
    f"floor(p * 100) > 40 as is_fraud from ({_PR}) as q", "transaction_id"))
def _legacy(spark, sf_dir):
    return tidy(explain.legacy_response(_probability(spark, sf_dir).drop("raw_probability")))


# ---- contributions of a fixed linear margin ---------------------------------------------

WEIGHTS = [((i * 37) % 23 - 11) / 13 for i in range(len(schema.FEATURES))]
MEANS = [((i * 17) % 7) / 3 for i in range(len(schema.FEATURES))]


def contributions(spark, sf_dir):
    feats = features.transform(features.impute(tx(spark, sf_dir)), ["transaction_id"])
    filled = feats.fillna(0.0, schema.FEATURES)
    return explain.linear_contributions(filled, schema.FEATURES, WEIGHTS, MEANS, ["transaction_id"])


def ranked(spark, sf_dir, three_way=True, **options):
    described = explain.describe_contributions(contributions(spark, sf_dir), three_way, schema.FEATURES)
    return explain.rank_contributions(described, names=schema.FEATURES, **options)


_F = feature_sql().replace("round(cast(", "coalesce(cast(").replace(" as double) + 1e-10, 6)", " as double), 0e0)")
_GRAPH = "case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in schema.GRAPH_FEATURES.items()) + " end"
_LONG = (", f as materialized (" + _F + "), long as (" + " union all ".join(
    f"select transaction_id, {i} as position, '{n}' as feature, {n} as value, ({w!r}e0) * ({n} - ({m!r}e0)) as c from f"
    for i, (n, w, m) in enumerate(zip(schema.FEATURES, WEIGHTS, MEANS)))
    + f"), item as (select transaction_id, position, feature, {round_sql('value')} as value, round_even(c, 6) as contribution, "
      "round_even(abs(c), 6) as absolute_contribution, round_even(abs(c) / case when t = 0 then 1 else t end * 100, 2) as contribution_percentage, "
      "case when c > 0 then 'increases_risk' when c < 0 then 'reduces_risk' else 'neutral' end as direction, "
      f"{_GRAPH} as raw_gnn_field from (select *, sum(abs(c)) over (partition by transaction_id) as t from long) as l)")
_COLUMNS = ("transaction_id, feature, {v} contribution_percentage, direction, raw_gnn_field")


def _long_sql(where, order, k):
    return with_tx("").rstrip() + _LONG + (
        "\nselect transaction_id, rank, feature, value, contribution, direction, raw_gnn_field from (select *, "
        f"row_number() over (partition by transaction_id order by {order}, position) as rank from item where {where}) as r where rank <= {k}")


def _long(spark, sf_dir, column, k=10):
    rows = explain.long_form(ranked(spark, sf_dir, k=k), column, ["transaction_id"])
    return tidy(rows.drop("absolute_contribution", "contribution_percentage"))


@query("explain_top_contributors", _long_sql("true", "absolute_contribution desc", 10))
def _top(spark, sf_dir):
    return _long(spark, sf_dir, "top_contributors")


@query("explain_top_positive", _long_sql("contribution > 0", "contribution desc", 10))
def _positive(spark, sf_dir):
    return _long(spark, sf_dir, "top_positive_contributors")


@query("explain_top_negative", _long_sql("contribution < 0", "contribution", 10))
def _negative(spark, sf_dir):
    return _long(spark, sf_dir, "top_negative_contributors")


@query("explain_graph_contributors", _long_sql("raw_gnn_field is not null", "absolute_contribution desc", 99))
def _graph(spark, sf_dir):
    return _long(spark, sf_dir, "graph_contributors")


@query("explain_top8_legacy", _long_sql("true", "absolute_contribution desc", 8).replace(
    "contribution, direction", "contribution, case when contribution > 0 then 'increases_risk' else 'decreases_risk' end as direction"))
def _top8(spark, sf_dir):
    rows = explain.long_form(ranked(spark, sf_dir, three_way=False, k=8), "top_contributors", ["transaction_id"])
    return tidy(rows.drop("absolute_contribution", "contribution_percentage"))


@query("explain_share_of_total", with_tx("").rstrip() + _LONG +
       "\nselect transaction_id, feature, round(contribution_percentage, 1) as share from item where raw_gnn_field is not null")
def _share(spark, sf_dir):
    rows = explain.long_form(ranked(spark, sf_dir), "graph_contributors", ["transaction_id"])
    return rows.select("transaction_id", "feature", F.round("contribution_percentage", 1).alias("share"))


def _bad_split(partition: str, order: str) -> str:
    return bad_rows(f"select split, label_is_fraud, count(*) as \"rows\" from (select label_is_fraud, {_split_case()} as split from ("
                    f"select label_is_fraud, row_number() over ({partition} order by {order}) - 1 as i, count(*) over ({partition}) as n "
                    "from bad) as o) as s group by 1, 2")


@query("split_temporal_defective", _bad_split("", "transaction_dt nulls last, coalesce(transaction_id, '')"))
def _temporal_defective(spark, sf_dir):
    """Rows without an id or a label, and repeated ids, are split like all others."""
    marked = positions.temporal_split(materialize(defective(spark, sf_dir), "transactions"), fetch=100)
    return tidy(marked.groupBy("split", "label_is_fraud").agg(F.count(F.lit(1)).alias("rows")))


@query("typology_codes", with_tx("select transaction_id, label_typology, list_position(["
       + ", ".join(f"'{t}'" for t in schema.TYPOLOGIES) + "], label_typology)::bigint - 1 as code from tx", "transaction_id", "label_typology"))
def _typologies(spark, sf_dir):
    """Name to number and back; the name comes from the number."""
    coded = tx(spark, sf_dir).select("transaction_id", typology_code(F.col("label_typology")).alias("code"))
    return tidy(coded.withColumn("label_typology", typology_name(F.col("code"))))
