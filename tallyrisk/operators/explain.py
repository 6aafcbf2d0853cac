"""Scores as responses: probabilities, risk bands and ranked contributions.

A row's contributions are ranked inside the row, as a sorted array, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.scalars import half_even, literal_lookup, quick_round

BASIS = "raw_margin"


def score_response(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`raw_probability` and `probability` (calibrated) to the published score columns."""
    p, raw = F.col("probability"), F.col("raw_probability")
    return scored.withColumns({
        "raw_model_probability": half_even(raw, 6),
        "raw_model_probability_percentage": half_even(raw * 100, 2),
        "probability_percentage": half_even(p * 100, 2),
        "risk_score": half_even(p * 100, 0).cast("int"),
        "classification_threshold": F.lit(threshold),
        "is_fraud": p >= threshold,
        "probability": half_even(p, 6),
    }).drop("raw_probability")


def legacy_response(scored: DataFrame) -> DataFrame:
    """The older rule: truncated risk, fraud above 40, four digits."""
    risk = F.greatest(F.least(F.floor(F.col("probability") * 100), F.lit(100)), F.lit(0)).cast("int")
    return scored.withColumns({"risk_score": risk, "is_fraud": risk > 40,
                               "probability": half_even(F.col("probability"), 4)})


def linear_contributions(features: DataFrame, names: Sequence[str], weights: Sequence[float],
                         means: Sequence[float], keep: Sequence[str]) -> DataFrame:
    """Exact contributions of a linear margin: w * (x - mean) per feature."""
    items = [
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(n) - F.lit(float(m)))).alias("contribution"))
        for n, w, m in zip(names, weights, means)]
    return features.select(*keep, _written(items).alias("contributions"))


def _direction(c: Column, three_way: bool) -> Column:
    if three_way:
        return F.when(c > 0, "increases_risk").when(c < 0, "reduces_risk").otherwise("neutral")
    return F.when(c > 0, "increases_risk").otherwise("decreases_risk")


def _written(items: Sequence[Column]) -> Column:
    """An array of items that are written out, which Spark compiles; it interprets lambdas. The slice is the whole array:
    it keeps the optimizer from putting the array in place of each of the many uses of its items."""
    return F.slice(F.array(*items), 1, len(items))


def _items(names: Sequence[str] | None) -> Column | list[Column]:
    items = F.col("contributions")
    return items if names is None else [items[i] for i in range(len(names))]


def describe_contributions(rows: DataFrame, three_way: bool = True, names: Sequence[str] | None = None) -> DataFrame:
    """Turn `contributions` into full items: rounded value, size, share of the total, direction,
    position in the feature order, and the raw graph field where there is one. `names` are the features of
    the contributions, where all rows have the same in the same order."""
    def item(x, i, sum_of_sizes, raw_field, rounded):
        c = x["contribution"]
        return F.struct(
            i.alias("position"), x["feature"].alias("feature"), x["value"].alias("value"),
            rounded(c, 6).alias("contribution"), rounded(F.abs(c), 6).alias("absolute_contribution"),
            rounded(F.abs(c) / sum_of_sizes * 100, 2).alias("contribution_percentage"),
            _direction(c, three_way).alias("direction"), raw_field.alias("raw_gnn_field"))

    items = _items(names)
    if names is not None:
        total = sum((F.abs(x["contribution"]) for x in items), F.lit(0.0).cast("double"))
        summed = rows.withColumn("_total", total)
        summed = summed.withColumn("_total", F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")))
        return summed.withColumn("contributions", _written([
            item(x, F.lit(i), F.col("_total"), F.lit(schema.GRAPH_FEATURES.get(name)).cast("string"), quick_round)
            for i, (x, name) in enumerate(zip(items, names))])).drop("_total")
    total = F.aggregate(items, F.lit(0.0).cast("double"), lambda acc, x: acc + F.abs(x["contribution"]))
    # one-element array: its lambda variable holds the total, which is otherwise worked out
    # again for every item once projections are merged
    packed = F.array(F.struct(F.when(total == 0, 1.0).otherwise(total).alias("total"), items.alias("items")))
    described = F.transform(packed, lambda y: F.transform(y["items"], lambda x, i: item(
        x, i, y["total"], literal_lookup(x["feature"], schema.GRAPH_FEATURES, None), half_even)))
    return rows.withColumn("contributions", described[0])


def _ranked(items: Column | list[Column], key: str, sign: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """The wanted items, largest `sign * key` first; equal ones keep the feature order."""
    def keyed(x):
        entry = F.struct((-sign * x[key]).alias("k"), x["position"].alias("p"), x.alias("x"))
        return entry if wanted is None or isinstance(items, Column) else F.when(wanted(x), entry)

    if isinstance(items, Column):
        kept = items if wanted is None else F.filter(items, wanted)
        return F.sort_array(F.transform(kept, keyed))["x"]
    ordered = F.sort_array(F.array(*map(keyed, items)))
    if wanted is None:
        return ordered["x"]
    others = sum((F.when(wanted(x), 0).otherwise(1) for x in items), F.lit(0))
    return F.slice(ordered, others + 1, F.lit(len(items)))["x"]  # the others are NULL, which comes first


def rank_contributions(rows: DataFrame, k: int = 10, top_names: int = 5, names: Sequence[str] | None = None) -> DataFrame:
    """Top k by size, top k raising, top k reducing, all graph features by size, and the names
    of the strongest factors each way. `names` as in `describe_contributions`."""
    items = _items(names)
    graph = [items[i] for i, name in enumerate(names or []) if name in schema.GRAPH_FEATURES] or F.filter(
        "contributions", lambda x: x["raw_gnn_field"].isNotNull())
    ranked = rows.withColumns({
        "top_contributors": F.slice(_ranked(items, "absolute_contribution", 1), 1, k),
        "top_positive_contributors": F.slice(_ranked(items, "contribution", 1, lambda x: x["contribution"] > 0), 1, k),
        "top_negative_contributors": F.slice(_ranked(items, "contribution", -1, lambda x: x["contribution"] < 0), 1, k),
        "graph_contributors": _ranked(graph, "absolute_contribution", 1),
    })
    return ranked.withColumns({
        "top_risk_factors": F.slice("top_positive_contributors", 1, top_names)["feature"],
        "top_risk_reducers": F.slice("top_negative_contributors", 1, top_names)["feature"],
    }).drop("contributions")


def long_form(ranked: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per item of a ranked list, with its rank.

    The list is a column before it is taken apart, since a generator interprets what it is given, and
    `inline` hands out whole items; picking fields after an explode would make the optimizer rank the
    list once per field. It is the outer form, without its empty rows: for the other one the optimizer works out
    every list once more, in a filter for its size.
    """
    fields = ["feature", "value", "contribution", "absolute_contribution", "contribution_percentage",
              "direction", "raw_gnn_field"]
    ranks = F.when(F.size(column) > 0, F.sequence(F.lit(1), F.size(column)))
    items = F.arrays_zip(ranks.alias("rank"), *[F.col(column)[f].alias(f) for f in fields])
    return ranked.select(*keep, column).select(*keep, items.alias("_items")).select(*keep, F.inline_outer("_items")).where("rank is not null")
