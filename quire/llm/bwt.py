"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

All strings grow at once, from their ends: each round puts one more symbol in
front of each, which inserts one suffix for each string into the sorted list.
Where it goes follows from the transform alone: sorted stably by the symbol
before them, the rows of the list give the list of the next longer suffixes.
The common prefix of two neighbours there is one more than the least common
prefix between the rows they came from.

The transform, the common prefixes and the places are columns that each round
reads and writes from front to back. Columns over ``memory`` bytes are files in
the task's own scratch folder, which goes when the construction ends.
"""

from __future__ import annotations

import tempfile

import numpy as np


class _Columns:
    """Arrays that are in memory, or in files when they are large."""

    def __init__(self, memory: int):
        self.memory = memory
        self.folder = None
        self.n = 0

    def new(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.empty(n, dtype)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        self.n += 1
        return np.memmap(f"{self.folder.name}/{self.n}", dtype, "w+", shape=n)

    def drop(self, old: np.ndarray) -> None:
        if isinstance(old, np.memmap):
            import os

            os.unlink(old.filename)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _least(columns: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of columns[lo:hi], all ranges non-empty, by a table of the minima over powers of two."""
    out = np.empty(len(lo), columns.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # the power of two within the length
    table, span = columns, 1
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] - span])
        if len(table) <= span:
            break
        table = np.minimum(table[:-span], table[span:])
        span *= 2
    return out


def collection_bwt(symbols: np.ndarray, lengths: np.ndarray, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, common, place) of all non-empty suffixes of the strings, in order.

    symbols: the strings' bytes, one after the other; lengths: one for each, up
    to 254. bwt has the byte before each suffix in its string (-1 at a start),
    common the length of the prefix that it shares with the suffix before it,
    place where it starts in ``symbols``. Ends of strings differ from each
    other and precede every byte.
    """
    lengths = np.asarray(lengths, np.int64)
    m, ends = len(lengths), np.cumsum(lengths)
    alphabet, codes = np.unique(symbols, return_inverse=True)
    kind = np.uint8 if len(alphabet) < 256 else np.uint16
    codes = (codes + 1).astype(kind)  # 0: before the start of a string
    cols = _Columns(memory)
    try:
        before = np.concatenate([codes, np.zeros(1, kind)])
        has = lengths > 0
        bwt = np.where(has, before[np.maximum(ends - 1, 0)], 0).astype(kind)
        common = np.zeros(m, np.uint8)
        place = np.full(m, -1, np.int32)
        row = np.flatnonzero(has)  # of the suffix that each string has last got
        who = row.copy()
        for r in range(1, int(lengths.max(initial=0)) + 1):
            order = np.argsort(bwt, kind="stable")
            order = order[np.count_nonzero(bwt == 0) :]
            fresh = np.zeros(len(bwt), bool)
            fresh[row] = True
            string = np.zeros(len(bwt), np.int32)
            string[row] = who
            new = fresh[order]
            n = m + len(order)
            at = m + np.flatnonzero(new)
            old = np.ones(n, bool)
            old[at] = False
            own = string[order[new]].astype(np.int64)
            start = ends[own] - r
            nbwt, ncommon, nplace = cols.new(n, kind), cols.new(n, np.uint8), cols.new(n, np.int32)
            nbwt[old], ncommon[old], nplace[old] = bwt, common, place
            nbwt[at] = np.where(lengths[own] > r, before[np.maximum(start - 1, 0)], 0)
            nplace[at] = start
            # Neighbours of which one is new: what their rows had in common, and the symbol before both.
            touched = np.zeros(n + 1, bool)
            touched[at] = True
            touched[at + 1] = True
            touched[:m] = False
            q = np.flatnonzero(touched[:n])
            shared = np.zeros(len(q), np.uint8)
            inner = q > m
            a, b = order[q[inner] - m - 1], order[q[inner] - m]
            same = bwt[a] == bwt[b]
            value = np.zeros(len(a), np.uint8)
            if same.any():
                value[same] = _least(common, a[same] + 1, b[same] + 1) + 1
            shared[inner] = value
            ncommon[q] = shared
            for x in (bwt, common, place):
                cols.drop(x)
            bwt, common, place = nbwt, ncommon, nplace
            go = lengths[own] > r
            row, who = at[go], own[go]
        back = np.concatenate([[-1], alphabet.astype(np.int16)])
        return back[bwt[m:]], np.array(common[m:]), np.array(place[m:])
    finally:
        cols.close()
