"""Packs tokenised documents into sequences of fixed length by column generation.

A document is its token ids and a closing 0. It is cut into pieces of `size` ids and a shorter
rest. Only the histogram of rest lengths matters for packing, so the plan does not grow with the
table: a pattern says how often each length occurs in one sequence, a linear program finds how
often to use each pattern at the least padded length, and new patterns are priced by a knapsack
dynamic program over the dual values. A sequence is padded to `size` unless its length is a power
of two, so patterns that add up to a power of two cost no more than their length.

The program's solution is rounded down; the rests left over, at most a few per pattern whatever
the size of the table, are packed best-fit. Rests of one length are ranked (in slices, so a
frequent length does not end in one task) and dealt to the patterns by rank.

Defined results: a null or empty text is the single id 0; repeated rows are packed one by one; a
null doc_id is a value like any other; long texts are encoded whole; rests of one length are tied and dealt
in the order of doc_id and start; extra columns are not carried along; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import store

SIZE = 1024
GAP = 0.002  # stop when the plan is this close to the bound of the linear program
SLICE_ROWS = 100_000
CAREFUL_REFRESH = 50  # turns between two inversions of the base
CACHE = 400_000  # words whose ids a Python worker remembers

_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Token ids as little-endian 32-bit bytes.

    The vocabulary splits text before every single blank between two other characters, so the
    words of ordinary text are encoded one by one and remembered. `special` are the added tokens of the
    vocabulary (text, id): they are cut out of the text first, and what stands between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in special}
        # of two that start at one place the longer one counts
        listed = "|".join(re.escape(t) for t in sorted(self.special, key=lambda t: (-len(t), t)))
        self.cut = re.compile(f"({listed})") if special else None

    def ids(self, text: str) -> bytes:
        if self.cut is None:
            return self.plain(text)
        return b"".join(self.special[p] if k % 2 else self.plain(p) for k, p in enumerate(self.cut.split(text)) if p)

    def plain(self, text: str) -> bytes:
        if "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.known
        out = [np.array(self.encode(first), "<u4").tobytes()]
        for word in rest:
            found = known.get(word)
            if found is None:
                found = np.array(self.encode(" " + word), "<u4").tobytes()
                if len(word) <= 32:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = found
            out.append(found)
        return b"".join(out)


_encoders: dict[tuple, Encoder] = {}


def _encoder(*vocabulary) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(*vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), size: int = SIZE,
           with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if wanted, the ids of every piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, special)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for number, text in enumerate(batch.column(1).to_pylist()):
                data = encoder.ids(text or "") + b"\0\0\0\0"
                for at in range(0, len(data), 4 * size):
                    part = data[at:at + 4 * size]
                    row.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())),
                       *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _padded(total: int, size: int) -> int:
    return total if total & (total - 1) == 0 else size


def _fill(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth of a pattern for every exact total up to `size`, and the last length put in."""
    best = np.full(size + 1, -np.inf)
    last = np.zeros(size + 1, dtype=np.int64)
    best[0] = 0.0
    for total in range(1, size + 1):
        n = np.searchsorted(lengths, total, side="right")
        if n:
            options = best[total - lengths[:n]] + worth[:n]
            at = int(options.argmax())
            best[total], last[total] = options[at], at
    return best, last


def plan(counts: dict[int, int], size: int = SIZE, gap: float = GAP, limit: int = 200,
         careful: bool = False) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often) with how many sequences use each; covers `counts` exactly.

    Should the base of patterns turn singular, all is done again with larger pivots (`careful`)."""
    lengths = np.array(sorted(length for length, n in counts.items() if n), dtype=np.int64)
    if not len(lengths):
        return []
    need = np.array([counts[int(x)] for x in lengths], dtype=float)
    m = len(lengths)
    allowed = [p for p in (1 << k for k in range(size.bit_length())) if p < size]
    base = _greedy_base(lengths, need, size)
    cost = np.array([_padded(int(t), size) / size for t in lengths @ base])
    inverse = np.linalg.inv(base)
    use = np.maximum(inverse @ need, 0)
    floor = lengths @ need / size  # no plan is shorter than its ids
    sound, refresh = (base.copy(), use), CAREFUL_REFRESH if careful else 200
    for turn in range(limit):
        if turn % refresh == refresh - 1:  # rounding errors of the updates do not pile up
            try:
                inverse = np.linalg.inv(base)
            except np.linalg.LinAlgError:  # they did
                if not careful:
                    return plan(counts, size, gap, limit, True)
                base, use = sound  # the last sound patterns stand, the rest is fitted greedily
                break
            use = np.maximum(inverse @ need, 0)
            sound = base.copy(), use
        value = float(cost @ use)
        if value - floor <= gap * value:
            break
        duals = cost @ inverse
        best, last = _fill(lengths, duals, size)
        totals = [int(best.argmax()), *(p for p in allowed if np.isfinite(best[p]))]
        price = {t: (1.0 if i == 0 else t / size) for i, t in reversed(list(enumerate(totals)))}
        top = max(best[t] / c for t, c in price.items())
        if top <= 1 + 1e-9 or value - duals @ need / top <= gap * value:
            break
        total = max(price, key=lambda t: best[t] - price[t])
        column, left = np.zeros(m), total
        while left:
            column[last[left]] += 1
            left -= int(lengths[last[left]])
        step = inverse @ column
        fit = step > (max(1e-9, 1e-7 * float(np.abs(step).max())) if careful else 1e-9)
        ratios = np.where(fit, use / np.where(fit, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        if careful:  # of equal ratios the largest pivot
            out = int(np.where(ratios <= ratios[out] * (1 + 1e-12), step, -np.inf).argmax())
        use = np.maximum(use - ratios[out] * step, 0)
        use[out] = ratios[out]
        base[:, out], cost[out] = column, price[total]
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    rest = need.astype(np.int64)
    made: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-use):
        column = base[:, j].astype(np.int64)
        inside = column > 0
        times = min(int(use[j] + 1e-6), int((rest[inside] // column[inside]).min()))
        if times > 0:
            rest -= times * column
            made.append(({int(lengths[i]): int(column[i]) for i in np.flatnonzero(column)}, times))
    return made + _best_fit({int(x): int(n) for x, n in zip(lengths, rest) if n}, size)


def _greedy_pattern(there: np.ndarray, size: int) -> list[int]:
    """The longest length that is there (there[x] > 0), then what fills the room exactly if one or
    two lengths do, else the longest that fits."""
    longest = int(np.flatnonzero(there > 0)[-1])
    pattern, room = [longest], size - longest
    used = {longest: 1}
    while room > 0:
        fits = np.flatnonzero(there[:room + 1] > 0)
        fits = fits[[there[x] - used.get(int(x), 0) >= 1 for x in fits]] if len(fits) else fits
        if not len(fits):
            break
        pick = int(fits[-1])
        if pick != room:
            open_ = np.zeros(room + 1, dtype=bool)
            open_[fits] = True
            pairs = fits[open_[room - fits] & (2 * fits != room)]
            pick = int(pairs[-1]) if len(pairs) else pick
        pattern.append(pick)
        used[pick] = used.get(pick, 0) + 1
        room -= pick
    return pattern


def _greedy_base(lengths: np.ndarray, need: np.ndarray, size: int) -> np.ndarray:
    """A feasible start: greedy patterns, each used (in fractions) until one of its lengths is used
    up. Later patterns do not hold that length, so the columns are independent."""
    there = np.zeros(size + 1)
    there[lengths] = need
    base, place = np.zeros((len(lengths), len(lengths))), {int(x): i for i, x in enumerate(lengths)}
    for j in range(len(lengths)):
        pattern = _greedy_pattern(np.where(there > 0, np.maximum(there, size), 0), size)
        column: dict[int, int] = {}
        for x in pattern:
            column[x] = column.get(x, 0) + 1
        gone = min(column, key=lambda x: there[x] / column[x])
        times = there[gone] / column[gone]
        for x, n in column.items():
            base[place[x], j] = n
            there[x] = max(there[x] - n * times, 1e-9)
        there[gone] = 0
    return base


def _best_fit(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Greedy patterns of whole numbers until nothing is left."""
    there, out = np.zeros(size + 1, dtype=np.int64), []
    for length, n in counts.items():
        there[length] = n
    while there.any():
        pattern: dict[int, int] = {}
        for x in _greedy_pattern(there, size):
            pattern[x] = pattern.get(x, 0) + 1
        times = min(int(there[x]) // n for x, n in pattern.items())
        for x, n in pattern.items():
            there[x] -= n * times
        out.append((pattern, times))
    return out


def pack(cut: DataFrame, size: int = SIZE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    The driver sees one count per length. The table that deals ranks to patterns has a few rows
    per pattern, and there are no more patterns than lengths (plus the bounded rest), so it is
    broadcast. Ranks are counted in slices of about `slice_rows` rows of one length.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    deals, taken, sequences = [], {}, 0
    whole = counts.pop(size, 0)
    for pattern, times in plan(counts, size):
        at = 0
        for length in sorted(pattern, reverse=True):
            n, low = pattern[length], taken.get(length, 0)
            deals.append((length, low, low + n * times, n, sequences, at))
            taken[length] = low + n * times
            at += n * length
        sequences += times
    if whole:
        deals.append((size, 0, whole, 1, sequences, 0))
    parts = [(length, -(-n // slice_rows)) for length, n in [*counts.items(), (size, whole)] if n]
    deal = spark.createDataFrame(deals, "length long, low long, high long, each long, first long, at long")
    slices = spark.createDataFrame(parts, "length long, slices long")
    keyed = cut.join(F.broadcast(slices), "length").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "slices")).drop("slices")
    sizes = keyed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "slice", (F.sum("n").over(
        Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(order)).join(before, ["length", "slice"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1).drop("slice", "place", "before")
    dealt = ranked.join(F.broadcast(deal), "length").where("rank >= low and rank < high")
    return dealt.select(
        *[F.col(f"`{c}`") for c in cut.columns],
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("at") + (F.col("rank") - F.col("low")) % F.col("each") * F.col("length")).alias("offset"))


def packed(docs: DataFrame, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = (), size: int = SIZE,
           with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset."""
    return pack(store(pieces(docs, ranks_path, pattern, special, size, with_ids), "pieces"), size)
