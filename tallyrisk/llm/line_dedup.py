"""Drops lines that stand in many documents, except in the last document that holds them.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of `min_chars`
code points or more that stand in `min_docs` documents or more lose all their lines but those of
the largest doc_id.

1. Two Bloom filters over the 128-bit hashes of the keys, one for bits set by one row or more, one
   for bits set by two rows or more. Each task hands on the bits it has set, cut into pages of
   65 536; the pages are merged in Spark, so that only the second filter reaches the driver, and
   from there the tasks. Its size follows the bytes of the table up to `most_bits` (64 MB); a fuller
   filter lets more lines pass, never fewer.
2. Every row looks its keys up. Only those that may be repeats are shuffled: (key, document) pairs
   are made distinct, then counted per key, which also gives the largest doc_id. No pair of
   documents is built, and a key in very many documents is added up in the tasks.
3. The pairs to drop are joined back, keys with very many documents in slices, and collected per
   row, of which each has at most as many as it has lines.

Defined results: null and empty texts have one empty line; a null text stays null; rows with one
doc_id are one document, also where the doc_id is null, which counts as the smallest; repeated
rows each get their result; long texts are read whole, line by line; extra columns are kept,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.skew import heavy_keys, spread_join
from .common import free_name, store

BLANK = b" \t\n\x0b\x0c\r"
PAGE = 1 << 16


@dataclass(frozen=True)
class Rule:
    min_chars: int = 40
    min_docs: int = 5
    least_bits: int = 1 << 20
    most_bits: int = 1 << 29
    block: int = 1 << 20  # keys after which a task hands its bits on
    busy: int = 10_000  # documents of one key that one task joins


def key_of(line: bytes, min_chars: int) -> bytes | None:
    if len(line) < min_chars:
        return None
    key = line.strip(BLANK).lower()  # of bytes: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode(errors="replace")) < min_chars):
        return None
    return key


def _digests(text: bytes | None, min_chars: int) -> tuple[int, set[bytes]]:
    """Number of lines, and the hashes of the different keys."""
    lines = (text or b"").split(b"\n")
    keys = {k for line in set(lines) if (k := key_of(line, min_chars)) is not None}
    return len(lines), {xxhash.xxh3_128_digest(k) for k in keys}


def _bits(digests: list[bytes], bits: int) -> np.ndarray:
    """Two bit numbers per digest."""
    return (np.frombuffer(b"".join(digests), "<u8") & np.uint64(bits - 1)).astype(np.int64).reshape(-1, 2)


def _pages(docs: DataFrame, bits: int, rule: Rule) -> DataFrame:
    """page, once, twice: the bits a task has set once, or more than once, as 16-bit numbers."""
    def rows(held: list[bytes]) -> pa.RecordBatch:
        at, times = np.unique(_bits(held, bits), return_counts=True)
        page, first = np.unique(at // PAGE, return_index=True)
        ends, place, again = [*first[1:], len(at)], (at % PAGE).astype("<u2"), times > 1
        once, twice = [], []
        for a, b in zip(first, ends):
            once.append(place[a:b][~again[a:b]].tobytes())
            twice.append(place[a:b][again[a:b]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                                          names=["page", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[bytes] = []
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.extend(_digests(text, rule.min_chars)[1])
                if len(held) >= rule.block:
                    yield rows(held)
                    held = []
        yield rows(held)

    return docs.mapInArrow(run, "page int, once binary, twice binary")


def _merged(pages: DataFrame) -> DataFrame:
    """page, bits: which bits of a page two rows or more have set."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, counts = None, np.zeros(PAGE, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())],
                                              names=["page", "bits"])

        for batch in batches:
            for page, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if page != now:
                    if now is not None and (counts > 1).any():
                        yield done()
                    now = page
                    counts[:] = 0
                at = np.frombuffer(once, "<u2")  # different numbers, so each is counted
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(twice, "<u2")] = 2
        if now is not None and (counts > 1).any():
            yield done()

    return pages.repartition("page").sortWithinPartitions("page").mapInArrow(run, "page int, bits binary")


def seen_twice(docs: DataFrame, rule: Rule) -> tuple[bytearray, int]:
    """The second filter over the one text column of `docs`, and its number of bits."""
    size = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    bits = rule.least_bits
    while bits < min(size // 4, rule.most_bits):
        bits *= 2
    found = bytearray(bits // 8)
    for row in store(_merged(_pages(docs, bits, rule)), "repeated_bits").toLocalIterator():
        found[row["page"] * PAGE // 8:(row["page"] + 1) * PAGE // 8] = row["bits"]
    return found, bits


def _suspects(docs: DataFrame, text: str, lines: str, keys: str, rule: Rule) -> DataFrame:
    """The table with the number of lines, and the hashes of the keys that may be repeats."""
    filled, bits = seen_twice(docs.select(text), rule)
    sent = docs.sparkSession.sparkContext.broadcast(bytes(filled))
    del filled
    at, names = docs.columns.index(text), [*docs.columns, lines, keys]
    shape = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(keys, T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]):
        filled = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            counts, sizes, held = [], [], []
            for value in batch.column(at).cast(pa.binary()).to_pylist():
                n, digests = _digests(value, rule.min_chars)
                counts.append(n)
                sizes.append(len(digests))
                held += digests
            place = _bits(held, bits)
            passed = ((filled[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=1)
            ends = np.concatenate(([0], np.cumsum(passed)))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
            found = pa.array([d for d, p in zip(held, passed) if p], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=names)

    out = store(docs.mapInArrow(run, shape), "line_suspects")
    sent.destroy()
    return out


def repeated_lines(pairs: DataFrame, rule: Rule) -> DataFrame:
    """key, keep: the keys that stand in enough documents, and the largest doc_id. `pairs`: doc_id, key."""
    found = pairs.select("doc_id", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
    return found.where(F.col("n") >= rule.min_docs).select("key", "keep")


def _rewritten(rows: DataFrame, text: str, lines: str, dropped: str, keys: str, rule: Rule) -> DataFrame:
    """Drops the lines whose key is listed; counts them."""
    names = [c for c in rows.columns if c != keys]
    at, listed = rows.columns.index(text), rows.columns.index(keys)
    kept = [i for i in range(len(rows.columns)) if i != listed]
    shape = T.StructType([*(rows.schema[c] for c in names), T.StructField(dropped, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, counts = [], []
            for value, digests in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(listed).to_pylist()):
                wanted, all_lines, left = set(digests), value.split(b"\n"), []
                for line in all_lines:
                    key = key_of(line, rule.min_chars)
                    if key is None or xxhash.xxh3_128_digest(key) not in wanted:
                        left.append(line)
                texts.append(b"\n".join(left))
                counts.append(len(all_lines) - len(left))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type, safe=False)
            yield pa.RecordBatch.from_arrays([*(columns[i] for i in kept), pa.array(counts, pa.int64())], names=[*names, dropped])

    return rows.mapInArrow(run, shape)


def deduplicated(docs: DataFrame, lines: str, dropped: str, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows of `docs` with the lines dropped from the text, `lines` (before dropping) and `dropped`."""
    keys, mark, gone = (free_name(docs, c) for c in ("_keys", "_mark", "_gone"))
    found = _suspects(docs, text, lines, keys, rule).withColumn(mark, F.xxhash64(text))
    some = F.size(keys) > 0
    # a row is known by its doc_id and a hash of its text: rows equal in both have equal results
    pairs = found.where(some).select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("mark"), F.explode(keys).alias("key")).distinct()
    pairs = store(pairs, "line_pairs")
    heavy = store(heavy_keys(pairs, ["key"], rule.busy), "busy_lines")
    judged = spread_join(pairs, repeated_lines(pairs, rule), ["key"], F.xxhash64("doc_id", "mark"), "inner", heavy=heavy)
    drops = judged.where(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("doc_id", "mark").agg(F.collect_set("key").alias("gone"))
    drops = drops.select(F.col("doc_id").alias("_drop_id"), F.col("mark").alias("_drop_mark"), F.col("gone").alias("_drop_keys"))
    rows = found.where(some).alias("r").join(
        drops.alias("d"), F.col(f"r.`{doc_id}`").eqNullSafe(F.col("d._drop_id")) & (F.col(f"r.`{mark}`") == F.col("d._drop_mark")), "left")
    rows = rows.select(*[F.col(f"r.`{c}`") for c in (*docs.columns, lines)], F.col("d._drop_keys").alias(gone))
    whole = lambda df: df.select(*[F.col(f"`{c}`") for c in (*docs.columns, lines)], F.lit(0).cast("long").alias(dropped))
    changed = _rewritten(rows.where(F.col(gone).isNotNull()), text, lines, dropped, gone, rule)
    return whole(found.where(~some)).unionByName(whole(rows.where(F.col(gone).isNull()))).unionByName(changed)
