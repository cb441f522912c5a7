"""Suffix arrays by two-stage sorting, in NumPy."""

from __future__ import annotations

import numpy as np


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian integer; zeros follow the text."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    k = np.zeros(len(t), np.uint64)
    for j in range(8):
        k = (k << np.uint64(8)) | padded[j : j + len(t)]
    return k


def _smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; equal bytes inherit, the last suffix is larger."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    differs = np.full(n, n - 1)
    at = np.flatnonzero(t[:-1] != t[1:])
    differs[at] = at
    return less[np.minimum.accumulate(differs[::-1])[::-1]]


def _sort_directly(pos: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """`pos` ordered by their suffixes' first `depth` bytes, eight at a time; only ties are sorted further, pairs by one comparison."""
    n = len(word)
    at = lambda p, off: np.where(p + off < n, word[np.minimum(p + off, n - 1)], np.uint64(0))
    order = pos[np.argsort(word[pos])]
    key = word[order]
    active, new = np.arange(len(order)), np.r_[True, key[1:] != key[:-1]][: len(order)]
    for off in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, new = active[tied], new[tied]
        if not len(active):
            break
        p = order[active]
        key = at(p, off)
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(key)])
        first = begin[size == 2]
        swap = first[key[first] > key[first + 1]]
        for x in (p, key):
            x[swap], x[swap + 1] = x[swap + 1], x[swap]
        many = np.repeat(size > 2, size)
        if many.any():
            group = np.repeat(np.arange((size > 2).sum()), size[size > 2])
            k = key[many]
            o = np.argsort(k)
            for shift in range(0, int(group[-1]).bit_length(), 16):  # by group, least digits first: numbers of 16 bits are sorted in linear time
                o = o[np.argsort((group[o] >> shift).astype(np.uint16), kind="stable")]
            p[many], key[many] = p[many][o], k[o]
        order[active] = p
        new[1:] |= key[1:] != key[:-1]
    return order


def _next_small(small: np.ndarray) -> np.ndarray:
    """The first suffix from each on that is smaller than its successor; the length where there is none."""
    at = np.where(small, np.arange(len(small)), len(small))
    return np.minimum.accumulate(at[::-1])[::-1]


def two_stage(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of the bytes `t`, exact to the first `depth` bytes of the suffixes.

    Stage one sorts directly the suffixes smaller than their successors. Stage
    two scans the buckets of first bytes upwards: each suffix met puts the one
    before it, if that is larger than its successor, next into the bucket of its
    first byte, so all others fall into place unsorted. With `wanted` (flags) stage
    one takes those alone that the wanted suffixes are or come from: the result has
    all that are wanted and some others.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    small = _smaller_than_successor(t)
    chosen = small
    if wanted is not None:
        chosen = np.zeros(n + 1, bool)
        chosen[_next_small(small)[wanted]] = True
        chosen = chosen[:n]
    direct = _sort_directly(np.flatnonzero(chosen), _words(t), depth)
    edges = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # from the empty suffix
    out = []

    def induce(part: np.ndarray, c: int) -> None:
        before = part[part > 0] - 1
        first = t[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            o = np.argsort(first, kind="stable")
            before, first = before[o], first[o]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for piece, b in zip(np.split(before, cuts), first[np.r_[0, cuts]]):
                waiting[b].append(piece)

    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(part):
            out.append(part)
            induce(part, c)
            before = part[part > 0] - 1
            part = before[(t[before] == c) & ~small[before]]
        part = direct[edges[c] : edges[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
        waiting[c] = []
    return np.concatenate(out)


def adjacent_equal(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair in `sa`, whether their common prefix reaches `length`; both must lie whole in `t`."""
    word = _words(t)
    live = np.arange(len(sa) - 1)
    for off in sorted({*range(0, length - 7, 8), length - 8}):
        live = live[word[sa[live] + off] == word[sa[live + 1] + off]]
    out = np.zeros(max(len(sa) - 1, 0), bool)
    out[live] = True
    return out
