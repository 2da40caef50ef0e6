"""Vectorised text primitives over Arrow batches.

A batch of texts is one UTF-8 buffer with offsets, as Arrow keeps it. Words
are maximal runs of bytes outside ``{20, 09-0D}``. Hashes are 64-bit
polynomials over the whole buffer, so that any range costs two lookups.

Modulo a power of two a polynomial has the same value for some pairs of texts of
two letters (Thue-Morse sequences) from about a thousand letters on, whatever
its base. ``range_hash`` is therefore for ranges of a bounded length, a few
hundred symbols; whole words, lines and texts go through ``tree_hash``, which
never has more than BLOCK symbols in one polynomial. Two different values then
agree with a chance of about 2**-64; among n distinct ones the chance that any
two agree is n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one Arrow batch are worked on in pieces of about so many bytes.
PIECE = 1 << 19
#: Words of about so many bytes are hashed at once.
RUN = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed pseudo-random value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n + n // 4, 2 * RUN), _R if which == "up" else _RINV, np.uint64)
        base[0] = 1
        have = np.cumprod(base, dtype=np.uint64)
        if n <= 16 * PIECE:
            _powers[which] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """What ``range_hash`` needs; values: uint64, one for each symbol."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the symbol ranges [start, end); equal ranges hash alike wherever they stand."""
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(np.uint64))


#: Symbols of one polynomial in ``tree_hash``.
BLOCK = 32


def tree_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ranges of any length: of blocks of symbols, then of the blocks' hashes, until one is left."""
    sums = prefix_sums(values) if sums is None else sums
    n = end - start
    long = np.flatnonzero(n > BLOCK)
    if not len(long):
        return range_hash(sums, start, end)
    out = np.empty(len(n), np.uint64)
    short = np.flatnonzero(n <= BLOCK)
    out[short] = range_hash(sums, start[short], end[short])
    parts = -(-n[long] // BLOCK)
    row, place = ragged(parts)
    at = start[long][row] + place * BLOCK
    last = np.cumsum(parts)
    blocks = range_hash(sums, at, np.minimum(at + BLOCK, end[long][row]))
    out[long] = mix(tree_hash(blocks, last - parts, last) + n[long].astype(np.uint64))
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(table: pa.Table | pa.RecordBatch, column: str = "text", most: int = PIECE):
    """Slices of consecutive rows whose texts have about ``most`` bytes; a longer text stands alone."""
    if table.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(table.column(column)), 0)
    size = np.asarray(size.to_numpy() if isinstance(size, pa.ChunkedArray) else size.to_numpy(zero_copy_only=False), np.int64)
    total, start = 0, 0
    for i, x in enumerate(size.tolist()):
        if i > start and total + x > most:
            yield table.slice(start, i - start)
            start, total = i, 0
        total += x
    yield table.slice(start)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its first word for each text (one more than texts)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~WHITE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[0] = edge[n] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, RUN bytes of the buffer at a time: the working arrays are many times as large as what they are made of."""
    if not len(start):
        return np.zeros(0, np.uint64)
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(start[0], start[-1] + 1, RUN)), len(start)))
    out = np.empty(len(start), np.uint64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low = start[a]
        out[a:b] = tree_hash(BYTE[buf[low : end[b - 1]]], start[a:b] - low, end[a:b] - low)
    return out


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of each row: its row and its place in the row."""
    lengths = np.asarray(lengths, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
