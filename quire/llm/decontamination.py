"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and of benchmark items are TF-IDF vectors; document
frequencies are counted over all documents. A randomised decomposition of the
passage matrix gives a latent basis: every task multiplies the Gram matrix of
its passages with one random test matrix, the products are added up, and the
singular directions follow from the sum (single pass, Nystroem). They are
stacked, with a weight, under the benchmark's own passages; of the singular
directions of both the first are kept, as many as hold ENERGY of the weight of
every passage of the benchmark: a passage whose direction is left out is not
found, and passages that have nothing in common need a direction each. Passages of
documents are then projected; those whose cosine to a benchmark passage in the
latent space reaches NEAR are candidates. Around each candidate the longest
common subsequence of words with the item is taken: a share of STRONG is a
leak, a share of WEAK is one when the item's answer (its last words) stands
there too.

Words in more than STOP of the documents have no weight. Passages of items that
owe them over half of their weight are searched once more, in a space where all
words have some. Beside both an exact search finds every item whose words stand
in a document one after the other, however common they are and whatever is
around them; its cosine is 1 where no latent one reached NEAR.

A projected word's product with each benchmark passage is one number; nearly
all are close to zero. The large ones are kept as a list for each word, the
largest of the others bounds what they can add, and only passages that may
reach NEAR by that bound are projected in full, so none is lost. A benchmark is
worked off in blocks whose passages and corpus directions are at most RANK and
whose words are at most VOCABULARY, each with a latent space of its own. PASS
blocks are sketched in one scan of the documents and searched in another; an
item with more passages than a block has a pass of its own. What is broadcast has
a fixed bound for each block: items, basis (VOCABULARY words by RANK), and
counters.

Words are runs of letters in lower case. Null and empty texts, and items
without words, match nothing. Items under eight words need nine tenths of their
words in order. Repeated rows and items match each by itself; an empty table on
either side gives an empty result. Very long texts are searched whole, a piece of the
batch by themselves; long items have several passages. Other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import text as X
from quire.llm.toxicity import letter_runs

WIDTH, STRIDE = 32, 16
#: Items are one passage each up to so many words.
ITEM_WIDTH, ITEM_STRIDE = 96, 48
COUNTERS = 1 << 18
RANK, VOCABULARY = 256, 1 << 14
#: Share of the squared weight of each of a block's passages that its latent space holds.
ENERGY = 0.8
#: Blocks of one scan.
PASS = 8
#: Words in more than this share of documents don't count, but for passages that they make up.
STOP = 0.2
#: First words of an item by which copies of it are looked up; of shorter items all.
ANCHOR = 8
#: Directions of all documents' passages in the basis, and their weight against 1 for the benchmark's.
CORPUS_RANK, CORPUS = 32, 0.02
#: Products of a word with a benchmark passage under this are bounded instead of listed.
SMALL = 0.02
NEAR = 0.3
STRONG, WEAK, ANSWER = 0.7, 0.5, 0.5
ANSWER_WORDS = 6


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word of each text."""
    low, start, end, first = letter_runs(buf, off)
    return X.tree_hash(X.BYTE[low], start, end), first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _counted(batches, text):
    counts, n = np.zeros(COUNTERS + 1, np.int64), 0
    for batch in batches:
        for piece in X.pieces(batch, text):
            h, first = word_hashes(*X.utf8(piece.column(text)))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            counts[:COUNTERS] += np.bincount(np.unique(doc * COUNTERS + _bucket(h)) % COUNTERS, minlength=COUNTERS)
            n += len(first) - 1
    counts[COUNTERS] = n
    yield from _chunks(counts.astype(np.float64))


def _chunks(x: np.ndarray, size: int = 1 << 15):
    """Rows (part, values) of a flat array."""
    parts = [x[i : i + size] for i in range(0, len(x), size)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.float64).tobytes() for p in parts], pa.binary())], ["part", "v"])


def _added(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column("part").to_pylist(), batch.column("v"), strict=True):
            x = np.frombuffer(v.as_buffer(), np.float64)
            sums[k] = sums[k] + x if k in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "v"])


def summed(rows: DataFrame, n: int, size: int = 1 << 15) -> np.ndarray:
    """The sum over all tasks of a flat array of fixed length n; the parts are added on the executors."""
    parts = -(-n // size)
    got = rows.repartition(min(parts, 64), "part").mapInArrow(_added, "part int, v binary").collect()
    out = [np.zeros(min(size, n - k * size)) for k in range(parts)]
    for k, v in got:
        out[k] = out[k] + np.frombuffer(bytes(v), np.float64)
    return np.concatenate(out) if out else np.zeros(0)


def idf_table(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weight of each word bucket, from how many of all documents have it: without stop words, and with."""
    counts = summed(docs.select(text).mapInArrow(lambda b: _counted(b, text), "part int, v binary"), COUNTERS + 1)
    n = max(1.0, counts[-1])
    idf = (np.log((n + 1) / (counts[:-1] + 1)) + 1e-3).astype(np.float32)
    return np.where(counts[:-1] > max(STOP * n, 2), np.float32(0), idf), idf


@dataclass
class Copies:
    """Items by the hash of their first words, for each number of those."""

    words: list[np.ndarray]
    length: np.ndarray
    whole: np.ndarray
    anchors: dict[int, tuple[np.ndarray, np.ndarray]]  # sorted hashes, item of each

    @staticmethod
    def of(h: np.ndarray, first: np.ndarray) -> Copies:
        sums, begin, n = X.prefix_sums(h), first[:-1], np.diff(first)
        width = np.minimum(n, ANCHOR)
        hashes, anchors = X.range_hash(sums, begin, begin + width), {}
        for w in np.unique(width[n > 0]).tolist():
            items = np.flatnonzero(width == w)
            items = items[np.argsort(hashes[items], kind="stable")]
            anchors[w] = hashes[items], items
        return Copies([h[a:b] for a, b in zip(begin, first[1:], strict=True)], n, X.range_hash(sums, begin, first[1:]), anchors)

    def found(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) of all items that stand in a text word by word."""
        sums, out = X.prefix_sums(h), set()
        stop = np.repeat(first[1:], np.diff(first))
        for w, (hashes, items) in self.anchors.items():
            at = np.flatnonzero(np.arange(len(h)) + w <= stop)
            got = X.range_hash(sums, at, at + w)
            may = np.zeros(1 << 16, bool)
            may[hashes >> np.uint64(48)] = True
            at, got = (x[may[got >> np.uint64(48)]] for x in (at, got))
            low = np.searchsorted(hashes, got)
            some = hashes[np.minimum(low, len(hashes) - 1)] == got
            at, low, got = at[some], low[some], got[some]
            which, place = X.ragged(np.searchsorted(hashes, got, "right") - low)
            at, n = at[which], items[low[which] + place]
            fits = at + self.length[n] <= stop[at]
            at, n = at[fits], n[fits]
            same = X.range_hash(sums, at, at + self.length[n]) == self.whole[n]
            at, n = at[same], n[same]
            for x in set(zip((np.searchsorted(first, at, "right") - 1).tolist(), n.tolist(), at.tolist(), strict=True)):
                if x[:2] not in out and np.array_equal(h[x[2] : x[2] + self.length[x[1]]], self.words[x[1]]):
                    out.add(x[:2])
        return out


@dataclass
class Block:
    """Items of a block, and the latent space they are looked for in."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray
    idf: np.ndarray
    passages: np.ndarray  # benchmark passage x vocabulary, TF-IDF
    item: np.ndarray  # of each passage
    basis: np.ndarray | None = None
    #: Place of the first item among those of the pass.
    offset: int = 0

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Place in the vocabulary; its length for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == h, k, len(self.vocabulary))


def windows(first: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of all passages: ``width`` words every ``stride``, the last one reaching the end."""
    n = np.diff(first)
    row, place = X.ragged(np.where(n > 0, np.maximum(0, -(-(n - width) // stride)) + 1, 0))
    start = first[:-1][row] + place * stride
    return row, start, np.minimum(start + width, first[1:][row])


def most_passages(rank: int = RANK) -> int:
    """Passages whose directions fit the rank beside the corpus's, and whose words, if one item's, the vocabulary."""
    if rank <= CORPUS_RANK:
        raise ValueError(f"rank {rank} has no room beside {CORPUS_RANK} directions of the corpus")
    return min(rank - CORPUS_RANK, (VOCABULARY - ITEM_WIDTH) // ITEM_STRIDE + 1)


def dealt(items, most: int):
    """Lists of items with at most ``most`` passages and VOCABULARY words in all; one with more passages is alone. With each, its number of passages."""
    rows, held, seen = [], 0, set()
    for i, t in items:
        h, first = word_hashes(*X.utf8(pa.array([t], pa.string())))
        n, words = len(windows(first, ITEM_WIDTH, ITEM_STRIDE)[0]), set(h.tolist())
        if n > most:
            yield [(i, t)], n
        elif n:
            if held + n > most or len(seen | words) > VOCABULARY:
                yield rows, held
                rows, held, seen = [], 0, set()
            rows.append((i, t))
            held, seen = held + n, seen | words
    if rows:
        yield rows, held


def _owing(h: np.ndarray, start: np.ndarray, end: np.ndarray, idf: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Passages that have over half of their squared weight from stop words."""
    k = _bucket(h)
    whole, rest = (np.concatenate([[0.0], np.cumsum(w[k].astype(np.float64) ** 2)]) for w in (idf, without))
    return 2 * (rest[end] - rest[start]) < whole[end] - whole[start]


def make_block(items: list[tuple[object, str | None]], idf: np.ndarray, part: slice = slice(None), without: np.ndarray | None = None) -> Block:
    """A block of those passages of the items that are in ``part``; if weights without stop words are given, of those that owe these over half."""
    column = pa.array([t for _, t in items], pa.string())
    h, first = word_hashes(*X.utf8(column))
    words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    weight = idf[_bucket(h)]
    row, start, end = (x[part] for x in windows(first, ITEM_WIDTH, ITEM_STRIDE))
    if without is not None:
        mine = _owing(h, start, end, idf, without)
        row, start, end = row[mine], start[mine], end[mine]
    inside = np.cumsum(np.bincount(start, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1))[:-1] > 0
    vocabulary = np.unique(h[inside & (weight > 0)])
    if len(vocabulary) > VOCABULARY:
        raise ValueError(f"a block has {len(vocabulary)} words, over {VOCABULARY}")
    block = Block([i for i, _ in items], words, vocabulary, idf, np.zeros((0, 0), np.float32), np.zeros(0, np.int64))
    k = block.lookup(h)
    out = np.zeros((len(row), len(vocabulary) + 1), np.float32)
    for i, (a, b) in enumerate(zip(start, end, strict=True)):
        np.add.at(out[i], k[a:b], weight[a:b])
    block.passages, block.item = out[:, :-1], row
    return block


def _add_sketch(h: np.ndarray, first: np.ndarray, block: Block, padded: np.ndarray, total: np.ndarray) -> float:
    """Adds the Gram matrix of the passages, times the test matrix, to total; gives its trace."""
    d, trace = len(total), 0.0
    k, w = block.lookup(h), block.idf[_bucket(h)]
    hit = (k < d) & (w > 0)
    _, start, end = windows(first, WIDTH, WIDTH)
    sums = np.concatenate([[0], np.cumsum(hit)])
    a, b = sums[start], sums[end]
    kk, ww = k[hit], w[hit]
    some = b > a
    row, place = X.ragged((b - a)[some])
    at = a[some][row] + place
    if not len(at):
        return trace
    begin = np.cumsum((b - a)[some]) - (b - a)[some]
    for lo in range(0, len(begin), 4096):
        x = slice(begin[lo], begin[lo + 4096] if lo + 4096 < len(begin) else len(at))
        y = np.add.reduceat(padded[kk[at[x]]] * ww[at[x]][:, None], begin[lo : lo + 4096] - begin[lo], axis=0)
        order = np.argsort(kk[at[x]], kind="stable")
        ks = kk[at[x]][order]
        edge = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        total[ks[edge]] += np.add.reduceat((y[row[x] - lo] * ww[at[x]][:, None])[order], edge, axis=0)
        trace += float((ww[at[x]].astype(np.float64) ** 2).sum())
    return trace


def _sketched(batches, text, blocks: list[Block], tests: list[np.ndarray]):
    """For each block its sketch of this task's passages, with the trace behind, one after the other."""
    padded = [np.vstack([t, np.zeros((1, t.shape[1]), np.float32)]) for t in tests]
    totals, traces = [np.zeros(t.shape) for t in tests], [0.0] * len(tests)
    for batch in batches:
        for piece in X.pieces(batch, text, 2 * X.PIECE):
            h, first = word_hashes(*X.utf8(piece.column(text)))
            for i, block in enumerate(blocks):
                traces[i] += _add_sketch(h, first, block, padded[i], totals[i])
    yield from _chunks(np.concatenate([np.append(t.reshape(-1), x) for t, x in zip(totals, traces, strict=True)]))


def directions(own: np.ndarray, root: np.ndarray, energy: float = ENERGY) -> np.ndarray:
    """The first right singular vectors of ``own`` over ``root``, as columns, that hold ``energy`` of the squared weight of each row of own."""
    norms = np.sqrt(np.square(own).sum(1))
    unit = own[norms > 0] / norms[norms > 0][:, None]
    _, _, vt = np.linalg.svd(np.vstack([unit / max(1.0, np.sqrt(len(unit))), np.sqrt(CORPUS) * root]), full_matrices=False)
    held = np.cumsum(np.square(unit @ vt.T), axis=1) >= energy - 1e-9
    return vt[: int(held.argmax(1).max(initial=0)) + 1].T


def fit_bases(docs: DataFrame, blocks: list[Block], text: str = "text", rank: int = RANK, seed: int = 11) -> None:
    """Sets the bases of blocks: singular directions of their passages over those of all documents, with weight CORPUS."""
    blocks = [b for b in blocks if len(b.vocabulary)]
    if not blocks:
        return
    tests = [np.linalg.qr(np.random.default_rng(seed).normal(size=(len(b.vocabulary), min(CORPUS_RANK, len(b.vocabulary)))))[0].astype(np.float32) for b in blocks]
    flat = summed(docs.select(text).mapInArrow(lambda bs: _sketched(bs, text, blocks, tests), "part int, v binary"), sum(t.size + 1 for t in tests))
    for block, test in zip(blocks, tests, strict=True):
        (d, r), part, flat = test.shape, flat[: test.size + 1], flat[test.size + 1 :]
        y = part[:-1].reshape(d, r) / max(1e-9, part[-1])
        shift = 1e-8 * np.linalg.norm(y) + 1e-12
        y = y + shift * test
        core = test.T @ y
        low = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(r))
        root = np.linalg.solve(low, y.T)  # root.T @ root is the corpus's Gram matrix, as far as the sketch saw it
        basis = directions(block.passages.astype(np.float64), root)
        if basis.shape[1] > rank:
            raise ValueError(f"a block has {basis.shape[1]} directions, over {rank}")
        block.basis = basis.astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and which places of a (as bits) one ends with."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = masks.get(y)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    gone = full & ~v
    return gone.bit_count(), gone


def leaks(item: np.ndarray, stretch: np.ndarray) -> float:
    """Share of the item's words that stand in order in the stretch, 0 if that isn't enough for a leak."""
    if not len(item):
        return 0.0
    share = common_subsequence(item, stretch)[0] / len(item)
    if len(item) < 8:
        return share if share >= 0.9 else 0.0
    if share >= STRONG:
        return share
    tail = item[-ANSWER_WORDS:]
    if share >= WEAK and common_subsequence(tail, stretch)[0] >= ANSWER * len(tail):
        return share
    return 0.0


@dataclass
class Products:
    """What each word of the vocabulary adds to the cosine numerator of each benchmark passage."""

    dense: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    value: np.ndarray
    rest: np.ndarray


def products(block: Block) -> tuple[Products, np.ndarray]:
    """Products, a row of zeros behind them for other words; and the item of each passage that has a direction."""
    q = block.passages @ block.basis
    norms = np.sqrt((q**2).sum(1))
    some = norms > 1e-6 * np.sqrt((block.passages**2).sum(1))
    dense = block.basis @ (q[some] / norms[some][:, None]).T
    dense = np.vstack([dense, np.zeros((1, dense.shape[1]), np.float32)]).astype(np.float32)
    large = np.abs(dense) >= SMALL
    row, passage = np.nonzero(large)
    rest = np.where(large, 0, np.abs(dense)).max(1, initial=0)
    return Products(dense, np.searchsorted(row, np.arange(len(dense) + 1)), passage, dense[row, passage], rest), block.item[some]


def matches(h: np.ndarray, first: np.ndarray, block: Block, table: Products, item: np.ndarray) -> dict[tuple[int, int], tuple[float, float]]:
    """(row, item of the block) -> (overlap, cosine) of the leaks in the words of a piece of texts."""
    d, p = len(block.vocabulary), len(item)
    listed = np.diff(table.first)
    k, w = block.lookup(h), block.idf[_bucket(h)].astype(np.float64)
    hits = np.flatnonzero((k < d) & (w > 0))
    kh, wh = k[hits], w[hits]
    sums, rests = np.concatenate([[0.0], np.cumsum(w * w)]), np.concatenate([[0.0], np.cumsum(wh * table.rest[kh])])
    row, start, end = windows(first)
    norm = np.sqrt(np.maximum(sums[end] - sums[start], 1e-9))
    a, b = np.searchsorted(hits, start), np.searchsorted(hits, end)
    found: dict[tuple[int, int], tuple[float, float]] = {}
    for lo in range(0, len(row), 2048):
        hi = min(lo + 2048, len(row))
        seg, place = X.ragged((b - a)[lo:hi])
        at = a[lo:hi][seg] + place
        entry, place = X.ragged(listed[kh[at]])
        of = table.first[kh[at]][entry] + place
        score = np.bincount(seg[entry] * p + table.passage[of], table.value[of] * wh[at][entry], minlength=(hi - lo) * p).reshape(-1, p)
        i, j = np.nonzero(score + (rests[b] - rests[a])[lo:hi, None] >= NEAR * norm[lo:hi, None])
        for x in np.unique(i).tolist():  # in full, for the few that may be near
            ks, ws = kh[a[lo + x] : b[lo + x]], wh[a[lo + x] : b[lo + x]]
            js = j[i == x]
            cos = (table.dense[np.ix_(ks, js)] * ws[:, None]).sum(0) / norm[lo + x]
            for y, c in zip(js.tolist(), cos.tolist(), strict=True):
                t, n = int(row[lo + x]), int(item[y])
                if c < NEAR or found.get((t, n), (0.0, 0.0))[0] >= STRONG:
                    continue
                reach = len(block.words[n])
                share = leaks(block.words[n], h[max(int(first[t]), int(start[lo + x]) - reach) : min(int(first[t + 1]), int(end[lo + x]) + reach)])
                if share > found.get((t, n), (0.0, 0.0))[0]:
                    found[t, n] = (share, c)
    return found


@dataclass
class Group:
    """Items that are worked off in one pass: copies of them, and their blocks."""

    ids: list
    copies: Copies
    blocks: list[Block]

    @staticmethod
    def of(rows: list[tuple[object, str | None]], blocks: list[Block]) -> Group:
        h, first = word_hashes(*X.utf8(pa.array([t for _, t in rows], pa.string())))
        return Group([i for i, _ in rows], Copies.of(h, first), [b for b in blocks if b.basis is not None])


def _leaks_of(text_column, group: Group, tables: list) -> dict[tuple[int, int], tuple[float, float]]:
    """(row, item of the group) -> (overlap, cosine): the largest of what any block finds, and 1 for copies."""
    h, first = word_hashes(*X.utf8(text_column))
    found: dict[tuple[int, int], tuple[float, float]] = {}
    for block, (table, item) in zip(group.blocks, tables, strict=True):
        for (t, n), y in matches(h, first, block, table, item).items():
            found[t, n + block.offset] = max(found.get((t, n + block.offset), y), y)
    for x in group.copies.found(h, first):
        found[x] = (1.0, found[x][1] if x in found else 1.0)
    return found


def _searched(batches, key, text, group: Group):
    tables = [products(b) for b in group.blocks]
    for batch in batches:
        for piece in X.pieces(batch, text, 2 * X.PIECE):
            found = _leaks_of(piece.column(text), group, tables)
            pairs = sorted(found)
            if pairs:
                ids = piece.column(key).take(pa.array([t for t, _ in pairs], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([group.ids[n] for _, n in pairs], pa.int64()), pa.array([round(found[x][0], 6) for x in pairs]), pa.array([round(found[x][1], 4) for x in pairs])], ["doc_id", "item_id", "overlap", "cosine"])


def _cleaned(batches, text, group: Group):
    tables = [products(b) for b in group.blocks]
    for batch in batches:
        for piece in X.pieces(batch, text, 2 * X.PIECE):
            keep = np.ones(piece.num_rows, bool)
            keep[[t for t, _ in _leaks_of(piece.column(text), group, tables)]] = False
            yield piece.filter(pa.array(keep))


def blocks_of(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, rank: int):
    """The benchmark in groups of blocks that are searched in one scan, each block with its latent space."""
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    if not items.limit(1).count() or not docs.limit(1).count():
        return
    (without, idf), most = idf_table(docs, text), most_passages(rank)

    def worked(some):
        rows, blocks = [], []
        for part, n in some:
            slices = [slice(k, k + most) for k in range(0, n, most)]
            own = [make_block(part, without, p) for p in slices] + [make_block(part, idf, p, without) for p in slices]
            for block in own:
                block.offset = len(rows)
            blocks += [b for b in own if len(b.item)]
            rows += part
        fit_bases(docs, blocks, text, rank)
        return docs.sparkSession.sparkContext.broadcast(Group.of(rows, blocks))

    held: list = []
    for rows, n in dealt(items.orderBy(F.xxhash64("i", "t"), "i", "t").toLocalIterator(), most):
        rows = sorted(((i, t) for i, t in rows), key=lambda x: (x[0] is None, x[0], x[1] or ""))
        if n > most:
            yield worked([(rows, n)])
            continue
        held.append((rows, n))
        if len(held) == PASS:
            yield worked(held)
            held = []
    if held:
        yield worked(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, overlap, cosine): a row for each document (row) and item that it leaks."""
    schema = f"doc_id {dict(docs.dtypes)[key]}, item_id bigint, overlap double, cosine double"
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in blocks_of(docs, benchmark, text, item, item_text, rank):
        out = out.unionByName(docs.select(F.col(key), F.col(text)).mapInArrow(lambda bs, s=sent: _searched(bs, key, text, s.value), schema))
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """The rows of docs that leak no item, in one scan for each group of blocks and without a shuffle."""
    out = docs
    for sent in blocks_of(docs, benchmark, text, item, item_text, rank):
        out = out.mapInArrow(lambda bs, s=sent: _cleaned(bs, text, s.value), docs.schema)
    return out


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, overlap, cosine) of every leak."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
