"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ROWS_PER_TASK = 2_000_000
MOST_KEYS = 10_000
BUCKETS = 1 << 16


def heavy_keys(left: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK,
               most_keys: int = MOST_KEYS) -> DataFrame:
    """Keys with more rows than one task should hold, and in how many slices to cut them.

    A key is heavy above `rows_per_task` rows, or above a `most_keys`-th of the table where that is
    more: there are never more than `most_keys` of them, which bounds what a join broadcasts.

    Rows are counted by a short hash of the key first, so that map tasks send few and narrow partial
    counts. Only the keys of buckets above the limit, which hold every heavy key, are counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    buckets = left.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(buckets.agg(F.sum("_n").alias("_all")))  # one row
    limit = F.greatest(F.lit(rows_per_task), F.col("_all") / most_keys)
    full = buckets.crossJoin(total).where(F.col("_n") > limit).select("_bucket", F.col("_all"))
    counts = left.select(*keys, bucket).join(F.broadcast(full), "_bucket").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"))
    return counts.where(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_slices"))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_on: Column,
                how: str = "left", rows_per_task: int = ROWS_PER_TASK, heavy: DataFrame | None = None) -> DataFrame:
    """Join a large left side to a right side, cutting heavy left keys into slices.

    Left rows of a heavy key pick a slice by hashing `spread_on`, and the right rows of that key
    are repeated once per slice. Rows without a key match nothing and are spread out as well. No
    row is dropped.

    `left` is read twice, once for the key counts, unless `heavy` (from `heavy_keys`, stored) is
    handed in: do so where the same table is joined again and again, and store a left side that is
    the result of a long plan.
    """
    keys = list(keys)
    heavy = F.broadcast(heavy_keys(left, keys, rows_per_task) if heavy is None else heavy)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    keyless = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    salted = (
        left.join(heavy, keys, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(spread_on),
                                     F.when(keyless, F.lit(4096)).otherwise(slices)).cast("int"))
        .drop("_slices")
    )
    repeated = (
        right.join(heavy, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    added = [c for c in right.columns if c not in keys]
    return salted.join(repeated, keys + ["_slice"], how).select(*left.columns, *added)
