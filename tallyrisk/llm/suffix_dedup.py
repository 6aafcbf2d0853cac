"""Removes every byte covered by a `length`-byte string that also starts earlier.

Order of starts: smaller doc_id (null first), then earlier start. Strings are judged on the input.

1. Anchors. Every window of `length` bytes has an anchor, the leftmost k-gram with the smallest
   hash among the k-grams inside it. Neighbouring windows with one anchor form a segment. Equal
   windows have equal anchors at the same place in them, so only segments with an anchor that
   occurs again can hold a repeat.
2. Anchors are counted; rows whose anchor does not repeat are dropped, first with a bit map of
   fixed size (it may let some pass, and passes more on larger tables), then exactly.
3. Segments equal as a whole are added up to the first of them; the others are removed whole.
4. Different segments with one anchor meet in a shard. Its suffix array is built by induced
   sorting; suffixes next to each other whose permuted common prefix reaches `length` are equal
   windows, and all but the first of them are marked.
5. Anchors with more than `crowd` different segments (a line that stands in very many documents)
   go through steps 1 to 4 again with a longer k-gram, at last the whole window, where equal
   anchors mean equal windows and step 4 has nothing left to do. No group meets in one task.

Defined results: null and empty texts have no bytes; texts under `length` bytes keep all; rows equal
in doc_id and text are one document, and each gets its result; rows with one doc_id and different
texts are told apart by 15 bits of a text hash, in that order; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import store
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 100
GRAMS = (20, 64)  # k-gram lengths of the rounds; the last round takes the whole window
CROWD = 5_000
SHARD_BYTES = 4 << 20
BLOCK = 1 << 20
FILTER_BITS = 26

_RANDOM = np.random.default_rng(20_240_229)
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_OTHER = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram, from hashes of grams of half the size."""
    power, width, step = _BYTES[data], 1, int(_STEP)
    out, done = None, 0
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                n = len(data) - done - width + 1
                out, done = out[:n] * np.uint64((step * int(_MIX) + 2 * width) % 2**64 | 1) + power[done:done + n], done + width
        if width * 2 > k:
            break
        n = len(power) - width
        power = power[:n] * np.uint64(step | 1) + power[width:width + n]
        step, width = (step * step + 2) % 2**64, width * 2
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of every run of `width` keys."""
    got, reach = keys, 1
    while reach * 2 <= width:
        got, reach = np.minimum(got[:-reach], got[reach:]), reach * 2
    n = len(keys) - width + 1
    return np.minimum(got[:n], got[width - reach:width - reach + n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(_MIX) | 1, pow(int(_MIX) | 1, -1, 2**64)
    up, down = np.empty(n + 1, dtype=np.uint64), np.empty(n + 1, dtype=np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = base, inverse
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def segments(data: np.ndarray, valid: np.ndarray, k: int, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a buffer of at most about a million bytes: start, size, anchor, digest.

    `valid` marks the windows that lie inside one text.
    """
    grams = _grams(data, k)
    mask = np.uint64((1 << 21) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, length - k + 1) & mask).astype(np.int64)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(fresh)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    end = np.flatnonzero(last) + length
    if BLOCK not in _tables:
        _tables[BLOCK] = _powers(2 * BLOCK)
    up, down = _tables[BLOCK]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[data] * up[:len(data)], dtype=np.uint64)))
    digest = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP
    return start, end - start, grams[at[start]].view(np.int64), digest.view(np.int64)


def _buffers(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, or parts of long ones that overlap by length - 1 bytes, joined to buffers: bytes, valid
    windows, and the number of the text and its offset for every part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        begins = np.cumsum(sizes) - sizes
        valid = np.zeros(len(data) + 1, dtype=np.int64)
        valid[begins] += 1
        np.add.at(valid, begins + sizes - length + 1, -1)
        return data, np.cumsum(valid[:len(data) - length + 1]) > 0, begins, np.array([(p[0], p[1]) for p in parts], dtype=np.int64)

    for number, text in enumerate(texts):
        for begin in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[begin:begin + BLOCK + length - 1]
            if size and size + len(part) > BLOCK:
                yield joined()
                parts, size = [], 0
            parts.append((number, begin, part))
            size += len(part)
    if parts:
        yield joined()


# Documents and segments alike: doc_id, version (15 bits), base (offset of the bytes), bytes.
def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0x7FFF)).alias("version"), F.lit(0).cast("long").alias("base"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))


def _anchors(rows: DataFrame, k: int, length: int, wanted=None) -> DataFrame:
    """anchor, digest, doc_id, place, base of every segment; `place` packs version, start and size. With
    `wanted`, a bit map, only those whose anchor may repeat; without it only the anchors."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            version, base = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for data, valid, begins, origin in _buffers(texts, length):
                start, size, anchor, digest = segments(data, valid, k, length)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])
                    continue
                keep = np.flatnonzero(_may_hold(wanted.value, anchor))
                part = np.searchsorted(begins, start[keep], side="right") - 1
                row = origin[part, 0]
                place = (version[row] << 48) | ((base[row] + origin[part, 1] + start[keep] - begins[part]) << 8) | size[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep]), pa.array(digest[keep]), batch.column(0).take(pa.array(row)), pa.array(place),
                     pa.array(base[row])], names=["anchor", "digest", "doc_id", "place", "base"])

    schema = "anchor long" if wanted is None else f"anchor long, digest long, doc_id {kind}, place long, base long"
    return rows.mapInArrow(run, schema)


def _slots(anchor: np.ndarray) -> np.ndarray:
    return (anchor.view(np.uint64) * _STEP) >> np.uint64(64 - FILTER_BITS)


def _may_hold(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = _slots(anchor)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bit_map(repeated: DataFrame):
    """A map of 2^FILTER_BITS bits (8 MB, whatever the table) of the repeated anchors, broadcast."""
    def run(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, slot >> np.uint64(3), (1 << (slot & np.uint64(7))).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    words = repeated.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[words["at"].to_numpy()] = words["word"].to_numpy()
    return repeated.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _unpacked() -> list:
    place = F.col("place")
    return ["doc_id", F.shiftright(place, 48).alias("version"),
            F.shiftright(place, 8).bitwiseAND(F.lit((1 << 40) - 1)).alias("start"), place.bitwiseAND(F.lit(255)).alias("size")]


def _texts(rows: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments in `firsts`: anchor, doc_id, version, start, bytes."""
    listed = firsts.groupBy("doc_id", "version", "base").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("wanted"))
    listed = listed.withColumnsRenamed({"doc_id": "_d", "version": "_v", "base": "_b"})
    met = rows.where(F.octet_length("bytes") >= length).join(
        listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v")) & (F.col("base") == F.col("_b")))
    # cut out before the explode, so that no row of it carries the whole text
    parts = F.expr("transform(wanted, w -> struct(w.anchor as anchor, w.start as start,"
                   " substring(bytes, cast(w.start - base + 1 as int), cast(w.size as int)) as bytes))")
    return met.select("doc_id", "version", F.explode_outer(parts).alias("w")).select(
        "w.anchor", "doc_id", "version", "w.start", "w.bytes")


def repeats_in_shard(parts: list[bytes], order: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(part, first window, last window) of the windows of segments that also occur earlier; `order`
    ranks the texts the segments come from, `starts` is where they start there."""
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text = data.astype(np.int64) + 2
    text[begins + sizes] = 1  # closes a segment
    sa = suffix_array(np.append(text, 0), 258)[1:]
    shared = permuted_prefixes(data, sa, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(data)) - begins[owner]
    window = offset + length <= sizes[owner]
    starts_equal = np.zeros(len(sa), dtype=bool)
    starts_equal[1:] = (shared[sa[1:]] >= length) & window[sa[1:]] & window[sa[:-1]]
    group = np.cumsum(~starts_equal)
    inside = window[sa]
    sa, group = sa[inside], group[inside]
    ranked = np.lexsort((starts[owner[sa]] + offset[sa], order[owner[sa]], group))
    sa, group = sa[ranked], group[ranked]
    later = sa[np.concatenate(([False], group[1:] == group[:-1]))] if len(sa) else sa
    later.sort()
    if not len(later):
        return []
    cut = np.flatnonzero((np.diff(later) != 1) | (owner[later[1:]] != owner[later[:-1]])) + 1
    lows, highs = later[np.concatenate(([0], cut))], later[np.concatenate((cut - 1, [len(later) - 1]))]
    return list(zip(owner[lows].tolist(), offset[lows].tolist(), offset[highs].tolist()))


def _sorted_shards(texts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marks doc_id, version, start, stop from segments that share their anchor with others."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def flush(rows):
        rows = list({row[:4]: row for row in rows}.values())  # rows of equal documents name the same bytes
        keys = [(d is not None, d, v) for _, d, v, _, _ in rows]
        rank = {key: i for i, key in enumerate(sorted(set(keys)))}
        order = np.array([rank[key] for key in keys])
        starts = np.array([r[3] for r in rows])
        found = repeats_in_shard([r[4] for r in rows], order, starts, length)
        columns = list(zip(*((rows[p][1], rows[p][2], rows[p][3] + a, rows[p][3] + b + length) for p, a, b in found))) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["doc_id", "version", "start", "stop"])

    doc_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= shard_bytes and row[0] != rows[-1][0]:  # an anchor stays in one shard
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield flush(rows)

    placed = texts.repartition("anchor").sortWithinPartitions("anchor")
    return placed.select("anchor", "doc_id", "version", "start", "bytes").mapInArrow(
        run, f"doc_id {kind}, version long, start long, stop long")


def marks(rows: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD,
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, version, start, stop of stretches to remove; they may overlap."""
    k = grams[0] if grams else length
    counted = _anchors(rows, k, length).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    repeated = store(counted.where("n > 1").select("anchor"), "repeated")
    found = _anchors(rows, k, length, _bit_map(repeated)).join(repeated, "anchor")
    found = store(found, "segments")
    groups = store(found.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "place", "base")).alias("first")), "groups")
    met = found.join(groups, ["anchor", "digest"])
    again = met.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))))
    whole = again.select(*_unpacked()).select("doc_id", "version", "start", (F.col("start") + F.col("size")).alias("stop"))
    if k >= length:
        return whole
    digests = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("digests")).where("digests > 1")
    firsts = groups.join(digests, "anchor").select("anchor", "first.*").select("anchor", "base", *_unpacked())
    texts = store(_texts(rows, firsts, length), "texts")
    crowded = digests.where(F.col("digests") > crowd).select("anchor")
    few = texts.join(crowded, "anchor", "left_anti")
    result = whole.unionByName(_sorted_shards(few, length, shard_bytes))
    if crowded.isEmpty():
        return result
    many = texts.join(crowded, "anchor", "left_semi").select("doc_id", "version", F.col("start").alias("base"), "bytes")
    return result.unionByName(marks(store(many, "crowded"), length, grams[1:], crowd, shard_bytes))


def deduplicated(docs: DataFrame, length: int = LENGTH, with_kept: bool = True, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (removed, in order), kept_sha256 and the kept bytes."""
    rows = _documents(docs)
    found = store(marks(rows, length, **options), "marks")
    listed = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    listed = listed.withColumnsRenamed({"doc_id": "_d", "version": "_v"})
    met = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v")), "left")
    met = met.select("doc_id", "bytes", F.expr("sort_array(marks)").alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hashes, sizes, kept = [], [], [], []
            for i, wanted in enumerate(batch.column(2).to_pylist()):
                data = batch.column(1)[i].as_buffer().to_pybytes()
                runs: list[list[int]] = []
                for mark in wanted or ():
                    if runs and mark["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], mark["stop"])
                    else:
                        runs.append([mark["start"], mark["stop"]])
                digest, done, rest = hashlib.sha256(), 0, []
                for start, stop in [*runs, [len(data), len(data)]]:
                    digest.update(data[done:start])
                    if with_kept:
                        rest.append(data[done:start])
                    done = stop
                sizes.append(len(data))
                hashes.append(digest.hexdigest())
                spans.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join(rest))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(hashes, pa.string())]
            names = ["doc_id", "n_bytes", "spans", "kept_sha256"]
            if with_kept:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start: bigint, stop: bigint>>, kept_sha256 string"
    return met.mapInArrow(run, schema + ", kept binary" * with_kept)
