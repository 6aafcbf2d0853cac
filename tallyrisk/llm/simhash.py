"""SimHash near duplicates, found with a generalised pigeonhole over groups of bits.

A fingerprint has 64 bits: bit j is 1 if it is set in more than half of the XXH64 hashes (seed
42) of the text's three-word shingles. Two fingerprints are linked at `distance` or fewer
differing bits, and a class is what links connect.

Candidates: bits that agree or differ together are put into one partition. Partitions get
thresholds t_1..t_m with sum(t_i + 1) = distance + 1; two linked fingerprints then differ in at
most t_i bits of some partition i (t_i = -1: the partition is not probed). The number of
partitions and the thresholds come from dynamic programming over estimated candidate counts,
which rest on bit-pair counts of all fingerprints. Every fingerprint is filed under its value in
each probed partition and visits the values within t_i bits; pairs that meet are verified.

Buckets with more than `crowd` rows are not paired. Their fingerprints are filed under all 64-bit
values at most one bit away instead: two fingerprints share such a value exactly if they differ
in at most two bits, and each is linked to the smallest one there. No link is lost, and the work
stays in proportion to the rows of the bucket. (For other distances the values are half the
distance away, so the distance has to be even.)

Defined results: a text without words (null, empty, blank) has fingerprint 0, linked like any
other; fewer than three words count as one shingle; repeated rows share a class; a null doc_id
never names a class unless no other id is in it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, free_name, store

DISTANCE = 2
SHINGLE = 3
CROWD = 64
BITS = 64

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes, as a signed 64-bit number."""
    words = data.translate(_FOLD).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:n - 1])).tolist()
        hashes = [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    parts = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.bincount((parts + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    mark = (set_bits.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(mark, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """Add the fingerprint of the whole text as a long."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = pa.array([fingerprint(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    schema = docs.select("*", F.lit(0).cast("long").alias(into)).schema
    return docs.mapInArrow(run, schema)


def bit_pairs(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set, for all i and j."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for at in range(0, len(values), 65_536):
                bits = ((values[at:at + 65_536, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
            n += len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().astype(int).tolist(), n], pa.int64())],
            names=["at", "n"])

    sums = prints.select("print").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in sums:  # 4097 numbers, whatever the size of the table
        flat[row["at"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def agreement(n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two random fingerprints agree in bit i, and in both bits i and j."""
    n = max(n, 1)
    one = np.diag(pairs) / n
    both = pairs / n
    cells = [both, one[:, None] - both, one[None, :] - both, 1 - one[:, None] - one[None, :] + both]
    return one ** 2 + (1 - one) ** 2, sum(c ** 2 for c in cells)


def group_bits(single: np.ndarray, joint: np.ndarray, groups: int) -> list[list[int]]:
    """Partitions of nearly equal size; each takes in the bits that agree most with it."""
    excess = np.abs(joint - np.outer(single, single))
    np.fill_diagonal(excess, 0)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = len(free) // (groups - g)
        start = max(free, key=lambda b: (excess[b, list(free)].sum(), -b))
        group = [start]
        free.remove(start)
        while len(group) < size:
            best = max(free, key=lambda b: (excess[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(group)
    return out


def chances(group: list[int], single: np.ndarray, joint: np.ndarray, upto: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t bits of a group, t = 0..upto."""
    agree = [float(single[group[0]])]
    for before, bit in zip(group, group[1:]):
        agree.append(float(joint[before, bit] / max(single[before], 1e-12)))
    exactly = np.zeros(upto + 1)
    exactly[0] = 1.0
    for a in agree:
        a = min(max(a, 1e-9), 1.0)
        exactly = exactly * a + np.concatenate(([0.0], exactly[:-1])) * (1 - a)
    return np.cumsum(exactly).tolist()


def plan_probes(n: int, pairs: np.ndarray, distance: int = DISTANCE, probe_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, at the least estimated cost."""
    single, joint = agreement(n, pairs)
    best: tuple[float, list] | None = None
    for m in range(1, distance + 4):
        groups = group_bits(single, joint, m)
        # cost[spent]: the cheapest way to spend `spent` of the distance + 1 units on the groups so far
        cost: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for group in groups:
            chance = chances(group, single, joint, distance)
            after: dict[int, tuple[float, list]] = {}
            for spent, (so_far, chosen) in cost.items():
                for t in range(-1, distance + 1):
                    units = spent + t + 1
                    if units > distance + 1 or t >= len(group):
                        continue
                    variants = sum(len(list(combinations(range(len(group)), k))) for k in range(t + 1))
                    own = 0.0 if t < 0 else n * n / 2 * chance[t] + probe_cost * n * variants
                    if units not in after or so_far + own < after[units][0]:
                        after[units] = (so_far + own, chosen + [(group, t)] * (t >= 0))
            cost = after
        if distance + 1 in cost and (best is None or cost[distance + 1][0] < best[0]):
            best = cost[distance + 1]
    return best[1]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _within(c: Column, bits: list[int], upto: int) -> Column:
    """The values that differ from c in at most `upto` of the bits."""
    flips = [F.lit(_mask(f)) for k in range(upto + 1) for f in combinations(bits, k)]
    return F.transform(F.array(*flips), lambda x: c.bitwiseXOR(x))


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to connect every class."""
    if distance % 2:
        raise ValueError("the distance has to be even")
    n, pairs = bit_pairs(prints)
    filed = None
    for number, (bits, t) in enumerate(plan_probes(n, pairs, distance)):
        value = F.col("print").bitwiseAND(F.lit(_mask(bits)))
        rows = prints.select("print", F.lit(number).alias("part"), F.explode(_within(value, bits, t)).alias("value"),
                             value.alias("own"))
        filed = rows if filed is None else filed.unionByName(rows)
    filed = store(filed.select("part", "value", "print", (F.col("own") == F.col("value")).alias("home")), "filed")
    sizes = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows"))
    few = sizes.where((F.col("rows") > 1) & (F.col("rows") <= crowd)).select("part", "value")
    many = sizes.where(F.col("rows") > crowd).select("part", "value")
    members = store(filed.join(few, ["part", "value"], "left_semi"), "members")
    other = members.where("home").select("part", "value", F.col("print").alias("b"))
    met = members.join(other, ["part", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("b"))) <= distance)
    paired = met.where("print <> b").select(F.least("print", "b").alias("a"), F.greatest("print", "b").alias("b"))
    crowded = filed.join(many, ["part", "value"], "left_semi").select("print").distinct()
    balls = crowded.select("print", F.explode(_within(F.col("print"), list(range(BITS)), distance // 2)).alias("near"))
    first = balls.groupBy("near").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    starred = balls.join(first, "near").where("print <> a").select("a", F.col("print").alias("b"))
    return paired.unionByName(starred).distinct()


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """For distinct fingerprints with their smallest doc_id (print, doc_id): print, root (one of the
    fingerprints of the class) and component_id."""
    roots = components(links(prints.select("print"), distance))
    named = prints.join(roots.withColumnRenamed("vertex", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "root").select("print", "root", "component_id")


def _printed(docs: DataFrame) -> DataFrame:
    """doc_id, print and digest, which tells rows of one doc_id apart by their text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return store(with_fingerprint(rows, "print").drop("text"), "fingerprints")


def _classed(printed: DataFrame, distance: int) -> DataFrame:
    prints = store(printed.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "prints")
    return printed.join(store(classes(prints, distance), "classes"), "print")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, print, component_id."""
    return _classed(_printed(docs), distance).select("doc_id", "print", "component_id")


def unique_rows(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, with the columns of `docs`.

    Texts are shuffled once, for the join with the rows chosen; fingerprints travel without them.
    """
    printed = _printed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")).alias("f")
    chosen = _classed(printed, distance).groupBy("root").agg(first).select(
        F.col("f.doc_id").alias("_d"), F.col("f.digest").alias("_h"))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_h")), "left_semi")
    repeated = printed.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    # rows equal in doc_id and text: one of them stays
    mark = free_name(docs, "_digest")
    return kept.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
