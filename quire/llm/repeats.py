"""Repeated passages across documents, exactly, for indexes that are built shard by shard.

Windows of ``window`` symbols that are equal must meet in one shard. Each
window is named by the least hash of its ``core``-grams; neighbours of one name
form a segment, and the name deals it out. Only names that occur twice
anywhere can hold a repeat, and a segment that is equal to an earlier one is a
repeat as a whole, so what a shard indexes is the distinct segments of repeated
names. The steps, each linear in the input:

1. ask: each slice of documents sends its distinct names, packed, by name;
2. answer: names that occur twice go back to the slices that asked;
3. send: each slice sends its distinct segments of those names to the shards;
4. find: each shard builds its index and returns the windows that begin earlier elsewhere;
5. mark: each slice cuts the covered symbols out of its documents.

A slice is about a megabyte of documents, dealt by a hash of id and text, so text is
shuffled once and that shuffle is read three times. A frequent name costs one
entry a slice, however many documents have it. Names with more than ``Kind.hot``
distinct segments (a passage with many surroundings) would fill a shard: their
windows are dealt by a hash of the whole window instead and compared there one
by one, which gives the same result. Nothing is dropped or sampled.

Documents are in the order of their ids, null ids first; rows of one id follow
each other in the order of a hash of their texts, then of repeated rows. Null
texts are empty. A very long text is a slice of its own. Names, and whole
segments of at most twice the window, are told by 64-bit hashes (``quire.llm.text``):
among n distinct ones two agree with a chance of n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import text as X

#: Bytes of text in a slice, of packed names in an answer's group, and of text for each shard.
SLICE, NAMES, SHARD = 1 << 20, 8 << 20, 2 << 20
NULL_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Kind:
    """What a symbol, a window and an earlier place are."""

    window: int
    core: int
    #: Symbols are words; otherwise bytes.
    words: bool
    #: An earlier place of the same document counts.
    within: bool
    #: (strings, lengths, rank of string, place of string) -> windows to remove, one flag for each window of each string.
    find: Callable
    #: Distinct segments of a name from which its windows are dealt one by one.
    hot: int = 1024


@dataclass
class Slice:
    """The documents of a slice in order, as one row of symbols."""

    doc: np.ndarray
    tie: np.ndarray
    null: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    symbols: np.ndarray
    at: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def load(table: pa.Table, kind: Kind) -> Slice:
    ids = table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id")
    null = np.asarray(ids.is_null())
    doc = np.asarray(ids.fill_null(0), np.int64).copy()
    doc[null] = NULL_ID
    buf, off = X.utf8(table.column("text"))
    h = np.asarray(table.column("tie"), np.int64) >> 10 << 10
    order = np.lexsort((h, doc))
    d, hs = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (hs[1:] != hs[:-1])
    run = np.flatnonzero(new)
    tie = np.zeros(len(doc), np.int64)
    tie[order] = hs + np.arange(len(d)) - run[np.cumsum(new) - 1]
    length = np.diff(off)
    row, place = X.ragged(length[order])
    buf = buf[off[:-1][order][row] + place] if len(row) else buf[:0]
    off = np.concatenate([[0], np.cumsum(length[order])])
    out = Slice(doc[order], tie[order], null[order], buf, off, buf, off)
    if kind.words:
        out.starts, out.ends, out.at = X.words(buf, off)
        out.symbols = X.word_hashes(buf, out.starts, out.ends)
    return out


@dataclass
class Segments:
    start: np.ndarray
    count: np.ndarray
    name: np.ndarray
    doc: np.ndarray
    whole: np.ndarray
    sums: np.ndarray
    grams: np.ndarray


def segments(s: Slice, kind: Kind) -> Segments:
    """start: first window (symbols of the slice); count: its windows; name; doc: row of the slice; whole: hash of the segment."""
    values = s.symbols if kind.words else X.BYTE[s.symbols]
    n, w = len(values), kind.window - kind.core + 1
    sums = X.prefix_sums(values)
    none = np.zeros(0, np.int64)
    if n < kind.window:
        return Segments(none, none, none.astype(np.uint64), none, none.astype(np.uint64), sums, none.astype(np.uint64))
    at = np.arange(n - kind.core + 1)
    grams = X.range_hash(sums, at, at + kind.core)
    least, span = grams, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: span - w], least[w - span :])
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(s.at)
    has = size >= kind.window
    inside[s.at[:-1][has]] += 1
    np.add.at(inside, s.at[1:][has] - kind.window + 1, -1)
    v = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    if not len(v):
        return Segments(none, none, none.astype(np.uint64), none, none.astype(np.uint64), sums, grams)
    names = least[v]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1] + 1) | (names[1:] != names[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(v)))
    row, place = X.ragged((length + w - 1) // w)
    start = v[first][row] + place * w
    count = np.minimum(w, length[row] - place * w)
    doc = np.searchsorted(s.at, start, "right") - 1
    return Segments(start, count, least[start], doc, X.range_hash(sums, start, start + count + kind.window - 1), sums, grams)


def twice(g: Segments, kind: Kind) -> np.ndarray:
    """Segments that have their name's core-gram more than once, and so may repeat a window in themselves."""
    w = kind.window - kind.core + 1
    out = np.zeros(len(g.start), bool)
    reach = np.arange(2 * w - 1)
    for lo in range(0, len(out), 8192):
        a, c, h = g.start[lo : lo + 8192], g.count[lo : lo + 8192], g.name[lo : lo + 8192]
        idx = np.minimum(a[:, None] + reach[None, :], len(g.grams) - 1)
        out[lo : lo + 8192] = ((g.grams[idx] == h[:, None]) & (reach[None, :] < (c + w - 1)[:, None])).sum(1) > 1
    return out


def _binary(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _cuts(key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that brings equal keys together, and (key, from, to) of each."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if len(k) else np.zeros(1, np.int64)
    return order, [(int(k[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _deal(h: np.ndarray, n: int) -> np.ndarray:
    return (X.mix(h) % np.uint64(n)).astype(np.int64)


ASK = "grp bigint, slice bigint, names binary, often binary, kinds binary"


def ask(table: pa.Table, kind: Kind, groups: int) -> pa.Table:
    s = load(table, kind)
    g = segments(s, kind)
    own = int(table.column("slice")[0].as_py())
    again = twice(g, kind) if kind.within else np.zeros(len(g.start), bool)
    order = np.lexsort((g.whole, g.name))
    name, whole = g.name[order], g.whole[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    fresh = first.copy()
    fresh[1:] |= whole[1:] != whole[:-1]
    at = np.flatnonzero(first)
    names = name[at]
    add = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    often, kinds, self_again = np.minimum(add(np.ones(len(name))), 2), np.minimum(add(fresh), 65535), add(again[order]) > 0
    often = np.where(self_again, 3, often)
    order, cuts = _cuts(_deal(names, groups))
    rows = [(k, own, *_binary(names[order[a:b]], often[order[a:b]].astype(np.uint8), kinds[order[a:b]].astype(np.uint16))) for k, a, b in cuts]
    return _table(rows, ["grp", "slice", "names", "often", "kinds"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def _packed(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column, and how many each row has."""
    parts = [np.frombuffer(x.as_py(), dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


ANSWER = "slice bigint, names binary, flags binary"


def answer(table: pa.Table, kind: Kind) -> pa.Table:
    """flags: 1: many segments, 2: may repeat a window in one segment."""
    names, sizes = _packed(table.column("names"), np.uint64)
    often, _ = _packed(table.column("often"), np.uint8)
    kinds, _ = _packed(table.column("kinds"), np.uint16)
    u, inv = np.unique(names, return_inverse=True)
    total = np.bincount(inv, often.astype(np.float64), len(u))
    alone = np.bincount(inv, often == 3, len(u)) > 0
    distinct = np.bincount(inv, kinds.astype(np.float64), len(u))
    flags = (distinct > kind.hot).astype(np.uint8) + 2 * alone.astype(np.uint8)
    yes = (total >= 2)[inv]
    rows, at = [], 0
    for own, n in zip(table.column("slice").to_pylist(), sizes.tolist(), strict=True):
        pick = np.flatnonzero(yes[at : at + n]) + at
        if len(pick):
            rows.append((own, *_binary(names[pick], flags[inv[pick]])))
        at += n
    return _table(rows, ["slice", "names", "flags"], [pa.int64(), pa.binary(), pa.binary()])


SEND = "shard bigint, slice bigint, hot boolean, name binary, whole binary, flags binary, doc binary, tie binary, pos binary, at binary, count binary, data binary"
_SEND = ["shard", "slice", "hot", "name", "whole", "flags", "doc", "tie", "pos", "at", "count", "data"]


def send(docs: pa.Table, answers: pa.Table, kind: Kind, shards: int) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 9]
    if docs.num_rows == 0 or answers.num_rows == 0:
        return _table([], _SEND, kinds)
    s = load(docs, kind)
    g = segments(s, kind)
    own = int(docs.column("slice")[0].as_py())
    names, _ = _packed(answers.column("names"), np.uint64)
    flags, _ = _packed(answers.column("flags"), np.uint8)
    order = np.argsort(names, kind="stable")
    names, flags = names[order], flags[order]
    k = np.minimum(np.searchsorted(names, g.name), max(0, len(names) - 1))
    hit = np.flatnonzero(names[k] == g.name)
    _, one = np.unique(g.whole[hit], return_index=True)  # the first of equal segments
    pick = hit[np.sort(one)]
    mark = flags[k[pick]]
    rows = []

    def put(deal, which, hot, mark, name, whole, start, count, doc):
        order, cuts = _cuts(deal)
        for shard, a, b in cuts:
            i = order[a:b]
            st, ct, dd = start[i], count[i], doc[i]
            if hot:
                data = b""
            else:
                row, place = X.ragged(ct + kind.window - 1)
                data = np.ascontiguousarray(s.symbols[st[row] + place]).tobytes()
            rows.append((shard, own, hot, *_binary(name[i], whole[i], mark[i].astype(np.uint8), s.doc[dd], s.tie[dd], st - s.at[dd], st, ct.astype(np.int16)), data))

    cold = pick[mark & 1 == 0]
    put(_deal(g.name[cold], shards), cold, False, mark[mark & 1 == 0], g.name[cold], g.whole[cold], g.start[cold], g.count[cold], g.doc[cold])
    warm = pick[mark & 1 == 1]
    if len(warm):
        row, place = X.ragged(g.count[warm])
        at = g.start[warm][row] + place
        values = s.symbols if kind.words else X.BYTE[s.symbols]
        one, two = X.range_hash(g.sums, at, at + kind.window), X.range_hash(X.prefix_sums(X.mix(values + np.uint64(1))), at, at + kind.window)
        put(_deal(one, shards), None, True, np.ones(len(at), np.uint8), one, two, at, np.ones(len(at), np.int64), g.doc[warm][row])
    return _table(rows, _SEND, kinds)


FOUND = "slice bigint, spans binary"
_SPAN = np.dtype([("at", np.int64), ("a", np.int16), ("b", np.int16)])


def find(table: pa.Table, kind: Kind) -> pa.Table:
    """For each slice the windows to remove of the segments it sent: runs [a, b) of windows from ``at``."""
    out: dict[int, list[np.ndarray]] = {}

    def give(slices, at, a, b):
        spans = np.empty(len(at), _SPAN)
        spans["at"], spans["a"], spans["b"] = at, a, b
        order, cuts = _cuts(slices)
        for k, x, y in cuts:
            out.setdefault(k, []).append(spans[order[x:y]])

    for hot in (False, True):
        part = table.filter(pa.compute.equal(table.column("hot"), hot))
        if part.num_rows == 0:
            continue
        name, sizes = _packed(part.column("name"), np.uint64)
        whole, _ = _packed(part.column("whole"), np.uint64)
        flags, _ = _packed(part.column("flags"), np.uint8)
        doc, tie, pos, at = (_packed(part.column(c), np.int64)[0] for c in ("doc", "tie", "pos", "at"))
        count = _packed(part.column("count"), np.int16)[0].astype(np.int64)
        slices = np.repeat(np.asarray(part.column("slice"), np.int64), sizes)
        # Equal segments: all but the first are repeats as a whole, if an equal id is not what makes them so.
        order = np.lexsort((pos, tie, doc, whole, name))
        n, w = name[order], whole[order]
        first = np.ones(len(n), bool)
        first[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
        head = np.flatnonzero(first)
        lead = order[np.repeat(head, np.diff(np.append(head, len(n))))]  # the first one, for each in order
        later = ~first if kind.within else doc[order] > doc[lead]
        i = order[later]
        give(slices[i], at[i], np.zeros(len(i), np.int16), count[i])
        if hot:
            continue
        reps = order[first]  # sorted by name
        n = name[reps]
        edge = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1], [True]]))
        alone = np.repeat(np.diff(edge) == 1, np.diff(edge))
        reps = reps[~alone | (flags[reps] & 2 > 0) if kind.within else ~alone]
        if not len(reps):
            continue
        item = np.uint64 if kind.words else np.uint8
        data, _ = _packed(part.column("data"), item)
        length = count + kind.window - 1
        begin = np.cumsum(length) - length
        row, place = X.ragged(length[reps])
        strings = data[begin[reps][row] + place]
        gone = kind.find(strings, length[reps], doc[reps], tie[reps], pos[reps], kind.window)
        row, place = X.ragged(count[reps])
        starts_row = np.zeros(len(gone), bool)
        starts_row[np.cumsum(count[reps]) - count[reps]] = True
        opens = gone & (starts_row | ~np.concatenate([[False], gone[:-1]]))
        closes = gone & (np.concatenate([starts_row[1:], [True]]) | ~np.concatenate([gone[1:], [False]]))
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        own = reps[row[a]]
        give(slices[own], at[own], place[a], place[b] + 1)
        # Equal segments of rows with one id fare as the first of them.
        same = np.flatnonzero(~first & (doc[order] == doc[lead])) if not kind.within else ()
        if len(same):
            by = np.argsort(own, kind="stable")
            lo, hi = np.searchsorted(own[by], lead[same]), np.searchsorted(own[by], lead[same], "right")
            row, k = X.ragged(hi - lo)
            of, to = by[lo[row] + k], order[same][row]
            give(slices[to], at[to], place[a][of], place[b][of] + 1)
    rows = [(k, np.concatenate(v).tobytes()) for k, v in sorted(out.items())]
    return _table(rows, ["slice", "spans"], [pa.int64(), pa.binary()])


MARK = "doc_id bigint, n_symbols bigint, starts array<bigint>, ends array<bigint>, kept binary"


def mark(docs: pa.Table, found: pa.Table, kind: Kind) -> pa.Table:
    s = load(docs, kind)
    g = segments(s, kind)
    n = len(s.symbols)
    edges = np.zeros(n + 1, np.int64)

    def windows(first, count):  # windows [first, first + count) are repeats: the symbols under them go
        np.add.at(edges, first, 1)
        np.add.at(edges, first + count + kind.window - 1, -1)

    u, head, inv = np.unique(g.whole, return_index=True, return_inverse=True)
    lead = head[inv] if len(u) else np.zeros(0, np.int64)
    later = (np.arange(len(lead)) != lead) if kind.within else s.doc[g.doc] > s.doc[g.doc[lead]] if len(lead) else np.zeros(0, bool)
    windows(g.start[later], g.count[later])
    if found.num_rows:
        spans, _ = _packed(found.column("spans"), _SPAN)
        windows(spans["at"] + spans["a"], (spans["b"] - spans["a"]).astype(np.int64))
        if not kind.within and len(lead):  # equal segments of one document fare alike
            twins = np.flatnonzero((np.arange(len(lead)) != lead) & (s.doc[g.doc] == s.doc[g.doc[lead]]))
            order = np.argsort(spans["at"], kind="stable")
            key = spans["at"][order]
            at = g.start[lead[twins]]
            a, b = np.searchsorted(key, at), np.searchsorted(key, at, "right")
            row, place = X.ragged(b - a)
            of = order[a[row] + place]
            windows(g.start[twins[row]] + spans["a"][of], (spans["b"][of] - spans["a"][of]).astype(np.int64))
    gone = np.cumsum(edges)[:n] > 0
    edge = np.zeros(n + 1, bool)
    edge[s.at] = True
    opens = np.flatnonzero(gone & (edge[:n] | ~np.concatenate([[False], gone[:-1]])))
    closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    of = np.searchsorted(s.at, opens, "right") - 1
    cut = np.searchsorted(of, np.arange(len(s.doc) + 1))
    opens, closes = opens - s.at[of], closes - s.at[of]
    kept = []
    if kind.words:
        for i in range(len(s.doc)):
            a, b = int(s.at[i]), int(s.at[i + 1])
            keep = np.flatnonzero(~gone[a:b]) + a
            text = s.buf[s.off[i] : s.off[i + 1]].tobytes()
            base = int(s.off[i])
            if len(keep) == b - a:
                kept.append(b" ".join(text.split()))
            else:
                kept.append(b" ".join([text[x - base : y - base] for x, y in zip(s.starts[keep].tolist(), s.ends[keep].tolist(), strict=True)]))
    else:
        for i in range(len(s.doc)):
            a, b = int(s.off[i]), int(s.off[i + 1])
            kept.append(s.buf[a:b][~gone[a:b]].tobytes())
    lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
    ids = pa.array(s.doc, pa.int64(), mask=s.null)
    return pa.table([ids, pa.array(np.diff(s.at), pa.int64()), lists(opens), lists(closes), pa.array(kept, pa.binary())], ["doc_id", "n_symbols", "starts", "ends", "kept"])


def repeats(docs: DataFrame, kind: Kind, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_symbols, starts, ends, kept) of every row: the removed runs of symbols, and what remains."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    slices, groups, shards = (max(1, -(-total // x)) for x in (SLICE, NAMES * kind.window // 16, SHARD))
    own = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(slices))
    rows = docs.select(own.alias("slice"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    asked = rows.groupBy("slice").applyInArrow(lambda t: ask(t, kind, groups), ASK)
    answers = asked.groupBy("grp").applyInArrow(lambda t: answer(t, kind), ANSWER)
    sent = rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda a, b: send(a, b, kind, shards), SEND)
    found = sent.groupBy("shard").applyInArrow(lambda t: find(t, kind), FOUND)
    return rows.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(lambda a, b: mark(a, b, kind), MARK)
