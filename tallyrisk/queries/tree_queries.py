"""Boosted trees: split search, contributions and calibration against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans import boosting, isotonic
from ..session import materialize
from .base import query, round_sql, tidy, tx, with_tx

CUTS = {"velocity_24h": (1.0, 2.0, 4.0), "amount_inr": (500.0, 5000.0, 50000.0, 150000.0), "ip_reputation_score": (0.25, 0.5, 0.75),
        "geo_distance_km": (10.0, 200.0)}
_S = boosting.Shape(min_rows=20.0)
_CELLS = ", ".join(f"('{f}', t.{f}, {c}e0)" for f, cuts in CUTS.items() for c in cuts)


def _worth_sql(g: str, h: str) -> str:
    w = f"greatest(least(-sign({g}) * greatest(abs({g}) - {_S.l1}e0, 0) / ({h} + {_S.l2}e0), {_S.max_step}e0), -{_S.max_step}e0)"
    return f"(-(2 * {g} * {w} + ({h} + {_S.l2}e0) * {w} * {w} + 2 * {_S.l1}e0 * abs({w})))"


@query("boost_root_splits", with_tx(f""", t as (
  select *, case when label_is_fraud = 1 then 2.33e0 else 1e0 end as w from tx where label_is_fraud is not null),
base as (select sum(w * label_is_fraud) / sum(w) as p from t),
sums as (
  select feature, cut, sum(w * (p - label_is_fraud)) as ga, sum(w * p * (1 - p)) as ha,
    sum(case when coalesce(x, 0) <= cut then w * (p - label_is_fraud) else 0 end) as gl,
    sum(case when coalesce(x, 0) <= cut then w * p * (1 - p) else 0 end) as hl
  from t, base, lateral (values {_CELLS}) as v(feature, x, cut) group by 1, 2),
gains as (
  select feature, cut, case when hl >= {_S.min_rows}e0 and ha - hl >= {_S.min_rows}e0
    then {_worth_sql('gl', 'hl')} + {_worth_sql('(ga - gl)', '(ha - hl)')} - {_worth_sql('ga', 'ha')} end as gain from sums)
select feature, {round_sql('max(gain)', 3)} as gain, min(cut) filter (gain = best) as cut
from (select *, max(gain) over (partition by feature) as best from gains) as q group by feature""", *CUTS, "label_is_fraud"))
def _root_splits(spark, sf_dir):
    """Gain and cut of the best split of every feature at the root of the first tree."""
    rows = tx(spark, sf_dir).where("label_is_fraud is not null").select(
        *CUTS, F.col("label_is_fraud").alias("label"), F.when(F.col("label_is_fraud") == 1, 2.33).otherwise(1.0).alias("weight"))
    rows = materialize(rows, "labelled")
    found = boosting.root_splits(rows, list(CUTS), [np.array(c) for c in CUTS.values()], _S)
    return tidy(spark.createDataFrame(found, "feature string, gain double, cut double"), 3)


# a tree of two levels, where one feature splits twice: (feature, cut) at the root and on both sides, four leaves
_TREE = (("velocity_24h", 2.0), ("amount_inr", 5000.0), ("velocity_24h", 5.0))
_LEAVES = (-0.7, 0.2, 0.4, 1.5)
_A, _A2 = (f"(coalesce(velocity_24h, 0) <= {c}e0)" for c in (2.0, 5.0))
_B = "(coalesce(amount_inr, 0) <= 5000e0)"


@query("explain_shapley_values", with_tx(f""", m as (
  select transaction_id, {_A} as a, {_B} as b, {_A2} as a2 from tx),
c as (
  select count(*)::double as n, count(*) filter (a)::double as nl, count(*) filter (a and b)::double as nlb,
    count(*) filter (not a)::double as nr, count(*) filter (not a and a2)::double as nra from m),
shares as (select nl / n as pl, nlb / nl as pb, nr / n as pr, nra / nr as pa from c),
games as (
  select transaction_id,
    pl * (pb * {_LEAVES[0]}e0 + (1 - pb) * {_LEAVES[1]}e0) + pr * (pa * {_LEAVES[2]}e0 + (1 - pa) * {_LEAVES[3]}e0) as none,
    case when a then pb * {_LEAVES[0]}e0 + (1 - pb) * {_LEAVES[1]}e0 when a2 then {_LEAVES[2]}e0 else {_LEAVES[3]}e0 end as with_a,
    pl * (case when b then {_LEAVES[0]}e0 else {_LEAVES[1]}e0 end) + pr * (pa * {_LEAVES[2]}e0 + (1 - pa) * {_LEAVES[3]}e0) as with_b,
    case when a and b then {_LEAVES[0]}e0 when a then {_LEAVES[1]}e0 when a2 then {_LEAVES[2]}e0 else {_LEAVES[3]}e0 end as known
  from m, shares)
select transaction_id, {round_sql('none')} as bias, {round_sql('((with_a - none) + (known - with_b)) / 2')} as velocity,
  {round_sql('((with_b - none) + (known - with_a)) / 2')} as amount, {round_sql("known")} as margin from games""",
    "transaction_id", "velocity_24h", "amount_inr"))
def _shapley(spark, sf_dir):
    """Shapley values of two features in a given tree, with covers from the table."""
    names = ["velocity_24h", "amount_inr"]
    rows = materialize(tx(spark, sf_dir).select("transaction_id", boosting.feature_array(names).alias("x")), "rows")
    (_, c0), (_, c1), (_, c2) = _TREE
    a, b, a2 = F.col("x")[0] <= c0, F.col("x")[1] <= c1, F.col("x")[0] <= c2
    n, nl, nlb, nra = rows.agg(F.count(F.lit(1)), F.count_if(a), F.count_if(a & b), F.count_if(~a & a2)).first()
    cover = [n, nl, n - nl, nlb, nl - nlb, nra, n - nl - nra]
    whole = lambda *x: np.array(x, np.int64)
    tree = boosting.Tree(whole(1, 3, 5, -1, -1, -1, -1), whole(2, 4, 6, -1, -1, -1, -1), whole(0, 1, 0, -1, -1, -1, -1),
                         np.array([c0, c1, c2, 0, 0, 0, 0]), np.array([0, 0, 0, *_LEAVES]), np.array(cover, float), np.ones(7))
    found = boosting.contributions(rows, boosting.Boosted([tree], 0.0, 2), "x", ["transaction_id"])
    return tidy(found.select("transaction_id", "bias", F.col("amounts")[0].alias("velocity"), F.col("amounts")[1].alias("amount"),
                             (F.col("bias") + F.col("amounts")[0] + F.col("amounts")[1]).alias("margin")))


@query("isotonic_pools", with_tx(f""", points as (
  select ip_reputation_score as x, sum(label_is_fraud)::double as t, count(*)::double as n, row_number() over (order by ip_reputation_score) as i
  from tx where ip_reputation_score is not null and label_is_fraud is not null group by 1),
up as (select a.x, a.i, max(b.low) as fitted from points a, lateral (
    select min((u.t_to - l.t_before) / (u.n_to - l.n_before)) as low
    from (select i, sum(t) over (order by i) - t as t_before, sum(n) over (order by i) - n as n_before from points) as l,
      (select i, sum(t) over (order by i) as t_to, sum(n) over (order by i) as n_to from points) as u
    where l.i <= a.i and u.i >= a.i group by l.i) as b group by 1, 2)
select {round_sql('x', 4)} as score, {round_sql('fitted')} as fitted from up""", "ip_reputation_score", "label_is_fraud"))
def _isotonic(spark, sf_dir):
    """The fitted value at every score, against the max-min formula."""
    rows = materialize(tx(spark, sf_dir).select("ip_reputation_score", "label_is_fraud"), "scored")
    curve = isotonic.fit(rows, "ip_reputation_score", "label_is_fraud")
    points = rows.where("ip_reputation_score is not null and label_is_fraud is not null").select("ip_reputation_score").distinct()
    return tidy(isotonic.with_fitted(points, curve, "ip_reputation_score", "fitted").select(
        F.round(F.col("ip_reputation_score") + 1e-10, 4).alias("score"), "fitted"))
