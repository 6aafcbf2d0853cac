"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    return materialize(df, label)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


PAGE = 1 << 16


def bit_map(values: DataFrame, bit: Callable[[str], int], bits: int) -> bytearray:
    """A map of `bits` bits with the bit of every value of the one string column. Bits are made different and
    packed into pages of 8 KB in Spark; the driver gets only pages that have any."""
    def numbers(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.unique(np.array([bit(v) % bits for v in batch.column(0).to_pylist()], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found // PAGE), pa.array(found % PAGE)], names=["page", "place"])

    def packed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                page = np.zeros(PAGE, np.uint8)
                page[places] = 1
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page", "bits"])

    pages = values.mapInArrow(numbers, "page long, place long").groupBy("page").agg(F.collect_set("place").alias("places"))
    found = bytearray(max(bits, PAGE) // 8)
    for row in store(pages.mapInArrow(packed, "page long, bits binary"), "bits").toLocalIterator():
        found[row["page"] * PAGE // 8:(row["page"] + 1) * PAGE // 8] = row["bits"]
    return found


def map_bits(values: int, least: int = PAGE, most: int = 1 << 26, each: int = 64) -> int:
    """A power of two of about `each` bits per value, at most 8 MB; a fuller map only lets more pass."""
    bits = least
    while bits < min(values * each, most):
        bits *= 2
    return bits


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): vertex, root, one row per vertex with a link.

    Every round each vertex is merged into the neighbour that comes first in an order drawn
    anew for the round, which shrinks the graph by a constant factor on average whatever its
    shape, chains included. Rounds are stored, so a lost executor costs one round at most. The
    root is some vertex of the component.
    """
    edges = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(rounds))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda v: F.struct(F.xxhash64(turn, v).alias("r"), F.col(v).alias("v"))
        merged = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        merged = store(merged.select(F.col("a").alias("vertex"), F.least("best", rank("a"))["v"].alias("root")), "merge")
        rounds.append(merged)
        left = merged.select(F.col("vertex").alias("a"), F.col("root").alias("ra"))
        right = merged.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = store(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    found = rounds[-1]
    for merged in reversed(rounds[:-1]):
        later = found.select(F.col("vertex").alias("root"), F.col("root").alias("later"))
        found = merged.join(later, "root", "left").select("vertex", F.coalesce("later", "root").alias("root"))
    return store(found, "components")
