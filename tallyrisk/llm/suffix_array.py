"""Suffix arrays of one shard by induced sorting, over numpy arrays.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller
ones are sorted first, by their substrings and, where those repeat, by recursion on their names;
all others are induced from them in one pass up and one pass down the buckets. A pass goes symbol
by symbol and moves all suffixes of a bucket at once.
"""

from __future__ import annotations

import numpy as np


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is."""
    n = len(s)
    step = np.sign(np.diff(s))
    small = np.ones(n, dtype=bool)
    if n > 1:
        # an equal pair takes the class of the next unequal one
        at = np.where(step != 0, np.arange(n - 1), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        small[:-1] = np.where(nearest < n, step[np.minimum(nearest, n - 2)] > 0, True)
    return small


def _place(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, up: bool) -> None:
    """Append suffixes to their buckets in the given order, from the head (up) or the tail."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    sizes = np.diff(np.append(first, len(order)))
    within = np.arange(len(order)) - np.repeat(first, sizes)
    kinds = sorted_symbols[first]
    if up:
        sa[at[sorted_symbols] + within] = suffixes[order]
        at[kinds] += sizes
    else:
        sa[at[sorted_symbols] - within] = suffixes[order]
        at[kinds] -= sizes


def _induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array, given the leftmost-smaller suffixes in order."""
    n = len(s)
    counts = np.bincount(s, minlength=symbols)
    tails = np.cumsum(counts)
    heads = tails - counts
    mine = s[leftmost]
    sa = np.full(n, -1, dtype=np.int64)
    up = heads.copy()
    bounds = np.searchsorted(mine, np.arange(symbols + 1))  # leftmost ones of each symbol

    def larger(found: np.ndarray) -> np.ndarray:
        before = found[found > 0] - 1
        return before[~small[before]]

    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < up[c]:  # suffixes put here by smaller buckets, then by this one
            batch = sa[done:up[c]]
            done = up[c]
            more = larger(batch)
            if len(more):
                _place(sa, up, s[more], more, True)
        batch = leftmost[bounds[c]:bounds[c + 1]]
        more = larger(batch)
        if len(more):
            _place(sa, up, s[more], more, True)
    down = tails - 1

    def smaller(found: np.ndarray) -> np.ndarray:
        before = found[found > 0] - 1
        return before[small[before]]

    # the last suffix has no right neighbour that could induce it
    _place(sa, down, s[n - 1:], np.array([n - 1]), False)
    for c in np.flatnonzero(counts)[::-1]:
        done = tails[c] - 1
        while done > down[c]:
            batch = sa[down[c] + 1:done + 1][::-1]
            done = down[c]
            more = smaller(batch)
            if len(more):
                _place(sa, down, s[more], more, False)
        more = smaller(sa[heads[c]:up[c]][::-1])
        if len(more):
            _place(sa, down, s[more], more, False)
    return sa


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Sort suffixes by rank pairs; for texts whose symbols are nearly all different."""
    n = len(s)
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


def _names(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order; equal substrings share a name."""
    ends = np.append(leftmost[1:], len(s) - 1)
    place = np.full(len(s), -1, dtype=np.int64)
    place[leftmost] = np.arange(len(leftmost))
    turn = place[order]
    a, b = turn[:-1], turn[1:]
    sizes = ends - leftmost + 1
    same = sizes[a] == sizes[b]
    alive = np.flatnonzero(same)
    k = 0
    while len(alive):
        x, y = leftmost[a[alive]] + k, leftmost[b[alive]] + k
        differ = (s[x] != s[y]) | (small[x] != small[y])
        same[alive[differ]] = False
        k += 1
        alive = alive[~differ]
        alive = alive[sizes[a[alive]] > k]
    named = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(leftmost), dtype=np.int64)
    out[turn] = named
    return out, int(named[-1]) + 1


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of s, whose last symbol is its smallest and occurs once."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if symbols > n // 200:  # too few suffixes a bucket to move them together
        return _by_doubling(s)
    small = _classify(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_symbol = leftmost[np.argsort(s[leftmost], kind="stable")]
    rough = _induce(s, small, by_symbol, symbols)
    marked = np.zeros(n, dtype=bool)
    marked[leftmost] = True
    names, kinds = _names(s, small, leftmost, rough[marked[rough]])
    if kinds < len(names):
        order = suffix_array(names, kinds)
    else:
        order = np.empty(len(names), dtype=np.int64)
        order[names] = np.arange(len(names))
    return _induce(s, small, leftmost[order], symbols)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For every position, how many bytes its suffix shares with the one before it in the array, up
    to `cap`. Text order, eight bytes at a time; `data` (uint8) does not repeat across its zeros."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(cap + 8, dtype=np.uint8)))
    words = np.zeros(n + cap, dtype=np.uint64)
    for k in range(8):
        words |= padded[k:k + n + cap].astype(np.uint64) << np.uint64(8 * k)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, dtype=np.int64)
    alive = np.flatnonzero(before >= 0)
    for at in range(0, cap, 8):
        differ = words[alive + at] ^ words[before[alive] + at]
        stop = differ != 0
        low = differ[stop] & (~differ[stop] + np.uint64(1))
        bits = np.log2(low.astype(np.float64)).astype(np.int64)
        shared[alive[stop]] = at + bits // 8
        alive = alive[~stop]
    shared[alive] = cap
    return np.minimum(shared, cap)
