"""Numbers or short bytes in place of ids, for rows that are shuffled or stored on the way to a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TRIALS = 5


def hash_seed(ids: DataFrame, name: str = "node_id") -> int | None:
    """A seed for which `hashed` gives no two of these ids the same number; None if there is none among a
    few. `ids` is a stored table with one row per id."""
    for seed in range(TRIALS):
        met = ids.where(F.col(name).isNotNull()).groupBy(hashed(name, seed).alias("h")).agg(F.count(F.lit(1)).alias("n"))
        if met.where("n > 1").isEmpty():
            return seed
    return None


def hashed(name: str, seed: int | None) -> Column:
    """A number for an id, or the id itself where no seed was found. NULL stays NULL."""
    if seed is None:
        return F.col(name)
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.lit(seed), F.col(name).cast("string")))


def distinct_ids(df: DataFrame, *columns: str) -> DataFrame:
    """node_id: every id in the columns once, without NULL."""
    each = df.select(F.explode(F.array(*columns)).alias("node_id")).where(F.col("node_id").isNotNull())
    return unpacked(packed(each, "node_id").distinct(), each, "node_id")


def shortened(df: DataFrame, seed: int | None, *columns: str) -> DataFrame:
    return df.withColumns({c: hashed(c, seed) for c in columns})


def restored(df: DataFrame, ids: DataFrame, seed: int | None, *columns: str) -> DataFrame:
    """The ids back in place of their numbers. `ids` is the table that `seed` was found for."""
    if seed is None:
        return df
    for c in columns:
        known = packed(ids.select(hashed("node_id", seed).alias(c), F.col("node_id").alias(f"_{c}")), f"_{c}")
        df = df.join(known, c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return unpacked(df, ids.select(*[F.col("node_id").alias(c) for c in columns]), *columns)


HASH_BYTES = 32  # of a SHA-256


def _texts(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """The text columns among these as bytes, half as long where they hold a SHA-256 in hex digits. Nothing is
    lost: only such a text takes 32 bytes, other texts stay as they are and get one byte more from 32 bytes on."""
    def short(c):
        text, size = F.col(c), F.octet_length(c)
        plain = text.cast("binary")
        return F.when((size == 2 * HASH_BYTES) & text.rlike("^[0-9a-f]{64}$"), F.unhex(text)).when(
            size < HASH_BYTES, plain).otherwise(F.concat(plain, F.lit(b"\0")))
    return df.withColumns({c: short(c) for c in _texts(df, columns)})


def unpacked(df: DataFrame, original: DataFrame, *columns: str) -> DataFrame:
    """The texts back in place of the bytes of `packed`. `original` has the columns as they were."""
    def text(c):
        size = F.octet_length(c)
        return F.when(size == HASH_BYTES, F.lower(F.hex(c))).when(size < HASH_BYTES, F.col(c).cast("string")).otherwise(
            F.substring(F.col(c), F.lit(1), size - 1).cast("string"))
    return df.withColumns({c: text(c) for c in _texts(original, columns)})
