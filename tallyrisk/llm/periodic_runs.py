"""Runs of words that repeat with a period, in whole texts.

A run of period q is a stretch of words in which words q apart are identical, q is the smallest
such number, the stretch has 2q words or more and no neighbouring word extends it.

Texts of a batch are put one after another as arrays of word numbers, the longest first, with a
number of its own after each text, so that no run crosses texts.

1. Periods up to 8: words q apart are compared.
2. Periods over t = 8, 16, 32, ... up to 2t: a string synchronising set of windows of t/2 words. Of
   t/2 + 2 neighbouring windows the one with the smallest hash is selected, the first of them if
   equal. Windows with a period of a third of their length or less are never selected. A run has a
   selected window in its first period whose copy one period on is selected as well. Selected
   windows with equal words at a distance over t and up to 2t propose that distance. Equal windows
   that are selected lie at least t/6 apart, so each has at most a dozen partners.
3. Periods this omits belong to runs whose whole first period is highly periodic. It lies in a run
   found at an earlier scale, its copy lies in the next run of the same small period, and both runs
   touch. Where their roots match, all distances of the fitting remainder are proposed.
4. A proposed distance is extended both ways over hashes of 1, 2, 4, ... words; of stretches equal in
   start and end the smallest period counts.

Work is in proportion to n log n for n words, and memory to n log n numbers for the longest text of a
batch; a text is the unit of work, texts are spread over the tasks and nothing is shuffled.

Defined results: null and empty texts have no words and no runs; long texts are taken whole; equal
rows each get their result; extra columns are kept whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SHORT = 8  # periods up to this are compared word by word
LEAST = 12  # words of the shortest run that is returned
BLOCK = 1 << 17  # words worked on at once, unless one text has more

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return (x ^ (x >> np.uint64(29))) * _B


class _Hashes:
    """Hashes of all windows of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int):
        first = _mix(words.astype(np.uint64) + _A)
        self.levels = [first ^ (first >> np.uint64(32))]
        while 2 << (len(self.levels) - 1) <= longest:
            k, last = 1 << (len(self.levels) - 1), self.levels[-1]
            new = _mix(last[:-k] * _B + last[k:])
            self.levels.append(new ^ (new >> np.uint64(32)))

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on and from b on are equal."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.levels) - 1, -1, -1):
            hashes = self.levels[level]
            ok = (b < len(hashes)) & (a < len(hashes))
            ok[ok] = hashes[a[ok]] == hashes[b[ok]]
            a[ok] += 1 << level
            b[ok] += 1 << level
        # the highest level may fit more than once
        again = np.flatnonzero(a - start >= (2 << (len(self.levels) - 1)) - 1)
        if len(again):
            a[again] += self.extend(a[again], b[again])
        return a - start

    def extend_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are equal."""
        a, b, start = a.copy(), b.copy(), a
        for level in range(len(self.levels) - 1, -1, -1):
            hashes, k = self.levels[level], 1 << level
            ok = (a >= k) & (b >= k)
            ok[ok] = hashes[a[ok] - k] == hashes[b[ok] - k]
            a[ok] -= k
            b[ok] -= k
        again = np.flatnonzero(start - a >= (2 << (len(self.levels) - 1)) - 1)
        if len(again):
            a[again] -= self.extend_back(a[again], b[again])
        return start - a

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the windows of `size` words at a and b are equal."""
        out = np.zeros(len(a), bool)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            here, hashes = level == k, self.levels[k]
            x, y, rest = a[here], b[here], size[here] - (1 << int(k))
            out[here] = (hashes[x] == hashes[y]) & (hashes[x + rest] == hashes[y + rest])
        return out


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbouring keys."""
    got, reach = keys, 1
    while reach * 2 <= width:
        got, reach = np.minimum(got[:-reach], got[reach:]), reach * 2
    n = len(keys) - width + 1
    return np.minimum(got[:n], got[width - reach:width - reach + n])


def _unique(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and end, the smallest period of each."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _short_periods(words: np.ndarray) -> list[np.ndarray]:
    found = []
    for q in range(1, min(SHORT, len(words) - 1) + 1):
        same = np.flatnonzero(words[q:] == words[:-q])
        if len(same):
            cut = np.flatnonzero(np.diff(same) > 1) + 1
            start, end = same[np.concatenate(([0], cut))], same[np.concatenate((cut - 1, [len(same) - 1]))] + 1
            long = end - start >= q
            found.append(np.column_stack((start[long], end[long] + q, np.full(long.sum(), q))))
    return found


def _highly_periodic(runs: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which windows lie in a run whose period is at most a third of the window."""
    inside = runs[(3 * runs[:, 2] <= window) & (runs[:, 1] - runs[:, 0] >= window)]
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.minimum(inside[:, 0], n), 1)
    np.add.at(marks, np.minimum(inside[:, 1] - window + 1, n), -1)
    return np.cumsum(marks[:n]) > 0


def _equal_windows(hashes: np.ndarray, periodic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances proposed by equal selected windows."""
    width = t // 2 + 2
    none = np.uint64(2**64 - 1)
    bits = np.uint64(max(int(len(hashes)).bit_length(), 1))
    keys = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)  # ties: the first
    keys[periodic] = none
    least = _smallest(keys, width)
    least = least[least != none]
    chosen = np.unique((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    order = chosen[np.argsort(hashes[chosen], kind="stable")]
    value = hashes[order]
    at, far, step = [], [], 1
    while step < len(order):
        distance = order[step:] - order[:-step]
        near = (value[step:] == value[:-step]) & (distance <= 2 * t)
        if not near.any():
            break
        wide = near & (distance > t)
        at.append(order[:-step][wide])
        far.append(distance[wide])
        step += 1
    return (np.concatenate(at), np.concatenate(far)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _omitted(hashes: _Hashes, runs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances proposed by touching runs of one small period with one root."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = runs[(6 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] > t)]
    small = small[np.lexsort((small[:, 0], small[:, 2]))]
    if len(small) < 2:
        return none
    left, right = small[:-1], small[1:]
    touch = (left[:, 2] == right[:, 2]) & (right[:, 0] <= left[:, 1])
    left, right = left[touch], right[touch]
    if not len(left):
        return none
    # the place in the last period of the left run where the right run's root stands
    p = left[:, 2]
    pair = np.repeat(np.arange(len(p)), p)
    shift = np.arange(len(pair)) - np.repeat(np.cumsum(p) - p, p)
    place = left[pair, 1] - 2 * p[pair] + shift
    match = hashes.equal(place, right[pair, 0], p[pair])
    pair, place = pair[match], place[match]  # roots are primitive: one place at most
    left, right, p = left[pair], right[pair], p[pair]
    rest = (right[:, 0] - place) % p
    first = t + 1 + (rest - t - 1) % p
    count = np.maximum((2 * t - first) // p + 1, 0)
    pair = np.repeat(np.arange(len(p)), count)
    q = first[pair] + (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * p[pair]
    low = np.maximum(left[pair, 0], right[pair, 0] - q)
    high = np.minimum(left[pair, 1], right[pair, 1] - q)
    good = high - low >= q
    return low[good], q[good]


def find_runs(words: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rows (start, end, period) of all runs of 2 periods or more. `words` holds texts of `sizes` words, the
    longest first, each with a word after it that occurs nowhere else."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    longest = max(sizes)
    runs = _unique(np.concatenate([np.zeros((0, 3), np.int64), *_short_periods(words)]))
    hashes = _Hashes(words, max(longest // 2, 2))
    ends, lengths = np.cumsum(np.asarray(sizes) + 1), np.asarray(sizes)
    t, level = SHORT, SHORT.bit_length() - 2  # windows of t/2 = 2^level words
    while 2 * (t + 1) <= longest:
        n = int(ends[np.searchsorted(-lengths, -2 * (t + 1), side="right") - 1])  # shorter texts have no such period
        windows = hashes.levels[level][:n - t // 2 + 1]
        if len(windows) > t // 2 + 2:
            at, q = _equal_windows(windows, _highly_periodic(runs, t // 2, len(windows)), t)
            more, far = _omitted(hashes, runs, t)
            at, q = np.concatenate((at, more)), np.concatenate((q, far))
            if len(at):
                start = at - hashes.extend_back(at, at + q)
                end = at + q + hashes.extend(at, at + q)
                good = end - start >= 2 * q
                if good.any():
                    runs = _unique(np.concatenate((runs, np.column_stack((start, end, q))[good])))
        t, level = 2 * t, level + 1
    return runs


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Per text the rows (start, length, period) of its runs of `least` words or more, by start and period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    todo = deque(sorted((i for i, words in enumerate(texts) if len(words) >= least), key=lambda i: -len(texts[i])))
    while todo:
        size, part = 0, []
        while todo and (not part or size + len(texts[todo[0]]) < BLOCK):
            part.append(todo.popleft())
            size += len(texts[part[-1]])
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__  # a new word gets the next number
        pieces = []
        for k, i in enumerate(part):
            pieces.append(np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i])))
            pieces.append(np.array([-1 - k], np.int64))
        sizes = [len(texts[i]) for i in part]
        runs = find_runs(np.concatenate(pieces), sizes)
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        begins = np.cumsum([0, *(s + 1 for s in sizes)])
        owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
        runs = np.column_stack((runs[:, 0] - begins[owner], runs[:, 1] - runs[:, 0], runs[:, 2]))
        order = np.lexsort((runs[:, 2], runs[:, 0], owner))
        runs, owner = runs[order], owner[order]
        for k in np.unique(owner):
            out[part[k]] = runs[owner == k]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if len(runs):
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
        np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
    return b" ".join(words)


def with_runs(docs: DataFrame, runs: str, kept: str, text: str = "text", least: int = LEAST,
              prepare: Callable[[object, list[bytes]], list[bytes]] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Add `runs`, an array of (start, length, period) by start and period, and `kept`, the text without the
    repeated periods. `prepare` may change the words of a text first; it gets the doc_id and the words."""
    at, key = docs.columns.index(text), docs.columns.index(doc_id)
    names = [*docs.columns, runs, kept]
    item = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    shape = T.StructType([*docs.schema.fields, T.StructField(runs, T.ArrayType(item)), T.StructField(kept, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            # split() of bytes cuts at the six blanks 09-0D and 20 and at nothing else
            texts = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            if prepare:
                texts = [prepare(i, words) for i, words in zip(batch.column(key).to_pylist(), texts)]
            found = runs_of(texts, least)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            ends = np.concatenate(([0], np.cumsum([len(r) for r in found])))
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
            left = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), left], names=names)

    return docs.mapInArrow(run, shape)
