"""A compressed FM-index over sequences of integers.

The Burrows-Wheeler transform lies in a wavelet matrix: one row of packed bits
for each bit of a symbol, with a count for every 64 of them. Backward search
narrows a range of suffixes by one symbol at a time; all queries step together.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        packed = np.packbits(np.concatenate([flags, np.zeros(-n % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        part = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[w] + np.bitwise_count(part)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        x = symbols
        for k in range(self.depth - 1, -1, -1):
            bit = (x >> k) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        #: Where each symbol's stretch begins in the last arrangement.
        c = np.arange(sigma)
        self.begin = self._walk(c, np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        return self._walk(c, i) - self.begin[c]


def suffix_array(symbols: np.ndarray, most: int) -> np.ndarray:
    """Order of all suffixes by their first ``most`` symbols, by doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    span = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - span)] = rank[span:] + 1
        order = np.lexsort((nxt, rank))
        a, b = rank[order], nxt[order]
        step = np.zeros(n, np.int64)
        step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        span *= 2
        if span >= most or n == 0 or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Over strings of symbols 1..sigma-1, each followed by a 0; owner: a number for each string."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, sigma: int, owner: np.ndarray):
        n = len(symbols) + len(lengths)
        text = np.zeros(n, np.int64)
        string = np.repeat(np.arange(len(lengths)), lengths + 1)
        at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        text[at] = symbols
        order = suffix_array(text, int(lengths.max(initial=0)) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.n = n
        #: Least owner over ranges of suffixes: a row for each power of two.
        table = [owner[string[order]]]
        while len(table[-1]) > (span := 1 << (len(table) - 1)):
            table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        self.least = table

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with c and go on as those of the range."""
        return self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of non-empty ranges."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.least[0].dtype)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.least[k][lo[own]], self.least[k][hi[own] - (1 << int(k))])
        return out

    def matching_statistics(self, symbols: np.ndarray, ends: np.ndarray, begins: np.ndarray, owner: np.ndarray, most: int) -> np.ndarray:
        """For each end, the length (up to ``most``) of the longest stretch before it that also stands in a string of a smaller owner.

        symbols: the streamed documents; begins: where the document of each end begins.
        """
        length = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(ends > begins)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(1, most + 1):
            if not len(live):
                break
            lo, hi = self.step(symbols[ends[live] - step], lo, hi)
            ok = lo < hi
            live, lo, hi = live[ok], lo[ok], hi[ok]
            ok = self.least_owner(lo, hi) < owner[live]
            live, lo, hi = live[ok], lo[ok], hi[ok]
            length[live] = step
            ok = ends[live] - step > begins[live]
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return length
