"""Splits by exact position in a global order, without sorting the table.

A split only needs the rows at a few positions. `order_cuts` finds them by counting rows in
ever finer slices of the order; splitting is then a comparison per row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import spread_join

DAY_TO_MICRO = [86_400_000_000, 60_000_000, 10_000, 1]
HASH48 = [2**36, 2**24, 2**12, 1]
FETCH = 100_000


LAST = 2**63 - 1  # a NULL time stands after all others


def _order(ts: Column, row_id: Column) -> tuple[Column, Column]:
    """(at, id) that are never NULL: rows without a time come last, rows without an id first."""
    return F.coalesce(ts, F.lit(LAST)), F.coalesce(row_id.cast("string"), F.lit(""))


def order_cuts(rows: DataFrame, positions: list[int], widths: list[int], total: int,
               fetch: int = FETCH) -> list[tuple[int, str] | None]:
    """For each position the (at, id) of the row standing there in the order (at, id).

    `rows` has a long `at` and a string `id`, both filled. Positions at or past the end give None.
    All positions are searched together, one pass per width of the slices. Only histograms, and
    finally at most `fetch` rows a position, reach the driver. Rows equal in both stand together.
    """
    # per position still open: low and high bound of `at`, prefix of the id, rows before, rows inside
    open_, found = {}, {}
    for p in positions:
        if p < total:
            open_[p] = (None, None, "", p, total)
        else:
            found[p] = None

    def inside(bounds) -> Column:
        low, high, prefix, _, _ = bounds
        held = F.lit(True) if low is None else F.col("at").between(low, high)
        return held & F.startswith("id", F.lit(prefix)) if prefix else held

    for width in widths:
        wide = {p: b for p, b in open_.items() if b[4] > fetch}
        if not wide:
            break
        ranges = sorted({(b[0], b[1]) for b in wide.values()}, key=str)
        held = F.lit(False)
        for low, high in ranges:
            held = held | (F.lit(True) if low is None else F.col("at").between(low, high))
        slot = F.col("at") - F.pmod(F.col("at"), F.lit(width))
        groups = [(g["k"], g["count"]) for g in rows.where(held).groupBy(slot.alias("k")).count().collect()]
        for p, (low, high, prefix, left, _) in wide.items():
            mine = [g for g in groups if low is None or low <= g[0] <= high]
            start, left, size = _step(mine, left)
            open_[p] = (start, min(start + width - 1, LAST), prefix, left, size)
    for p, bounds in open_.items():
        low, high, prefix, left, size = bounds
        while size > fetch:
            # one single instant is still too large: go on by the leading characters of the id
            step = len(prefix) + 2
            groups = rows.where(inside((low, high, prefix, left, size))).groupBy(F.substring("id", 1, step).alias("k")).count().collect()
            prefix, left, size = _step([(g["k"], g["count"]) for g in groups], left)
            if len(prefix) < step:  # the whole id: all rows here are equal in time and id
                found[p] = (low, prefix)
                break
        if p not in found:
            here = rows.where(inside((low, high, prefix, left, size)))
            found[p] = tuple(sorted((r["at"], r["id"]) for r in here.select("at", "id").collect())[left])
    return [found[p] for p in positions]


def _step(groups, left):
    for key, n in sorted(groups):
        if left < n:
            return key, left, n
        left -= n
    raise ValueError("position lies outside the table")


def _before(at: Column, row_id: Column, cut) -> Column:
    if cut is None:
        return F.lit(True)
    return (at < cut[0]) | ((at == cut[0]) & (row_id < cut[1]))


def split_sizes(n: int, train: float, val: float, test: float) -> tuple[int, int]:
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must add up to 1")
    end = int(n * (1 - test))
    return int(end * (1 - val / (train + val))), end


def temporal_split(df: DataFrame, ts: str = "transaction_dt", row_id: str = "transaction_id",
                   train: float = 0.8, val: float = 0.1, test: float = 0.1,
                   fetch: int = FETCH) -> DataFrame:
    """Add `split`: first rows in time train, then val, the last ones test; ties break on the id."""
    at, ident = _order(F.unix_micros(ts), F.col(row_id))
    rows = df.select(at.alias("at"), ident.alias("id"))
    n = rows.count()
    cuts = order_cuts(rows, list(split_sizes(n, train, val, test)), DAY_TO_MICRO, n, fetch)
    return _labelled(df, at, ident, cuts)


def _labelled(df, at, row_id, cuts):
    return df.withColumn(
        "split",
        F.when(_before(at, row_id, cuts[0]), "train").when(_before(at, row_id, cuts[1]), "val").otherwise("test"))


def account_temporal_split(nodes: DataFrame, fetch: int = FETCH) -> DataFrame:
    """Account nodes by time of their last transaction: 80 % train, 10 % val, 10 % test."""
    at, ident = _order(F.unix_micros("last_tx"), F.col("node_id"))
    rows = nodes.select(at.alias("at"), ident.alias("id"))
    n = rows.count()
    if n < 20:
        raise ValueError("a split needs at least 20 account nodes")
    train_end = max(1, int(n * 0.80))
    cuts = order_cuts(rows, [train_end, max(train_end + 1, int(n * 0.90))], DAY_TO_MICRO, n, fetch)
    return _labelled(nodes, at, ident, cuts)


def cutoff_split(nodes: DataFrame, ts: str = "last_tx", row_id: str = "node_id",
                 fetch: int = FETCH) -> DataFrame:
    """Split by the dates standing at 80 % and 90 %: equal dates always stay together, NULL is the latest.
    A table without two rows of different dates is split at random."""
    at, ident = _order(F.unix_micros(ts), F.col(row_id))
    rows = nodes.select(at.alias("at"), ident.alias("id"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).first()
    n = seen["n"]
    if seen["a"] == seen["b"]:
        tenth = F.pmod(random_order(42, row_id), F.lit(10))
        return nodes.withColumn("split", F.when(tenth < 8, "train").when(tenth < 9, "val").otherwise("test"))
    low, high = order_cuts(rows, [int(n * 0.80), int(n * 0.90)], DAY_TO_MICRO, n, fetch)
    return nodes.withColumn(
        "split", F.when(at <= low[0], "train").when(at <= high[0], "val").otherwise("test"))


def random_order(seed: int, row_id: str) -> Column:
    """A reproducible shuffle: 48 bits of a hash of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(row_id)), 256), 1, 12),
                  16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str = "label_is_fraud", row_id: str = "transaction_id",
                     train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42,
                     fetch: int = FETCH) -> DataFrame:
    """Random split that keeps the class shares: each class is cut at the same ratios."""
    at, ident = _order(random_order(seed, row_id), F.col(row_id))
    rows = df.select(F.col(label).alias("label"), at.alias("at"), ident.alias("id"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    split = F.lit(None).cast("string")
    for value, n in sorted(sizes.items(), key=str):  # rows without a label are a class of their own
        mine = rows.where(F.col("label").eqNullSafe(F.lit(value)))
        cuts = order_cuts(mine, list(split_sizes(n, train, val, test)), HASH48, n, fetch)
        name = F.when(_before(at, ident, cuts[0]), "train").when(_before(at, ident, cuts[1]), "val").otherwise("test")
        split = F.when(F.col(label).eqNullSafe(F.lit(value)), name).otherwise(split)
    return df.withColumn("split", split)


def account_grouped_split(df: DataFrame, **options) -> DataFrame:
    """Temporal split in which an account stays whole: its last transaction decides."""
    marked = temporal_split(df, **options)
    latest = F.max_by("split", F.struct("transaction_dt", "transaction_id")).alias("split")
    owner = marked.groupBy("account_id_hash").agg(latest)
    return spread_join(df, owner, ["account_id_hash"], F.col("transaction_id"))


def split_statistics(df: DataFrame, label: str = "label_is_fraud") -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.col(label).cast("bigint")).alias("n_fraud"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"))
