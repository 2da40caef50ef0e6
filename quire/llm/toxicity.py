"""Toxicity: a convolutional text classifier, trained in numpy.

A word is a run of letters in lower case; its vector is the sum of hashed
embeddings of the word and of its first four and five bytes. Filters over one,
two and three words run along the whole text, the largest response of each is
kept, and a linear layer gives the logit. For scoring, embeddings and filters
are multiplied out once, so that a word costs three rows of a table.

Thresholds are calibrated by language on rows that are held back from the
fit. The language is told from the text, by its commonest small words, and
serves as nothing but the choice of a threshold: the logit is shifted so that
the threshold comes to stand at CUT.

The model is fitted on the driver from a bounded sample of labelled rows (MOST
of each label), of whole texts up to FIT_WORDS words; of longer ones runs that
lie evenly over the text are fitted on. Every document is scored over its whole
text. Null and empty texts have no word and get the score of no response. With
one label, or none, the score is 0. Rows that repeat score alike; of several
texts with one labelled id one is fitted on. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import sample
from quire.llm import text as X

#: Labelled rows of each label that are fitted on, at most.
MOST = 1500
#: Words of a text that are fitted on, at most, and in how many runs; all words are scored.
FIT_WORDS, FIT_RUNS = 1 << 15, 64
BUCKETS = 1 << 14
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
CUT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

#: Small words by which a language is told.
COMMON = {
    "en": "the and of to is that for it as was with be by on not he are this or from",
    "fr": "le la les des et un une du que qui dans pour par sur au avec est pas ce il",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "es": "el los las de y en que un una por con para del se no su al como lo es",
}
LANGS = tuple(COMMON)


def letter_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each run of letters, and the first run of each text."""
    low = X.LOWER[buf]
    blank = np.where(_LETTER[buf], low, np.uint8(32))
    start, end, first = X.words(blank, off)
    return low, start, end, first


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word (whole, first four bytes, first five), and the first word of each text."""
    low, start, end, first = letter_runs(buf, off)
    sums = X.prefix_sums(X.BYTE[low])
    ids = np.empty((3, len(start)), np.int32)
    for k, stop in enumerate((end, np.minimum(end, start + 4), np.minimum(end, start + 5))):
        ids[k] = (X.range_hash(sums, start, stop) >> np.uint64(64 - 14)).astype(np.int32)
    return ids, first


def _language_table() -> np.ndarray:
    table = np.zeros(BUCKETS, np.int8)
    for k, words in enumerate(COMMON.values()):
        buf = np.frombuffer(words.encode(), np.uint8)
        ids, _ = word_ids(buf, np.array([0, len(buf)]))
        for i in ids[0]:
            table[i] = k + 1 if table[i] in (0, k + 1) else -1  # of two languages: of none
    return np.maximum(table, 0)


_LANGUAGE = _language_table()


def languages(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the index in LANGS of the language most of whose small words it has."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    votes = np.bincount(doc * (len(LANGS) + 1) + _LANGUAGE[ids[0]], minlength=n * (len(LANGS) + 1)).reshape(n, -1)
    return votes[:, 1:].argmax(1)


@dataclass
class Net:
    """embed: a table for each of the three buckets; conv: DIM x (offsets of all widths) x FILTERS; out: one weight for each filter."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGS)))

    def tables(self) -> np.ndarray:
        """For each bucket, what a word there adds to each filter at each offset."""
        return (self.embed.reshape(-1, DIM) @ self.conv.reshape(DIM, -1)).reshape(3, BUCKETS, -1).astype(np.float32)

    def responses(self, part: np.ndarray, doc_end: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' values at each word; places that run over the text's end get the words there are."""
        n, out, o = len(part), [], 0
        part = part.reshape(n, -1, FILTERS)
        at = np.arange(n)
        for w in WIDTHS:
            v = part[:, o].copy()
            for j in range(1, w):
                ok = at + j < doc_end
                v[ok] += part[at[ok] + j, o + j]
            out.append(v)
            o += w
        return out

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        if ids.shape[1]:
            part = tables[0][ids[0]] + tables[1][ids[1]] + tables[2][ids[2]]
            has = np.flatnonzero(np.diff(first) > 0)
            for k, v in enumerate(self.responses(part, np.repeat(first[1:], np.diff(first)))):
                pooled[has, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(v, first[:-1][has], axis=0)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base

    def scores(self, ids: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
        z = self.logits(ids, first, tables) - self.shift[languages(ids, first)]
        return 1 / (1 + np.exp(-np.clip(z + np.log(CUT / (1 - CUT)), -40, 40)))


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, drop: float = 0.3, init: float = 0.02, seed: int = 7) -> Net:
    """Adam over small batches; texts: the three buckets of each word. Only the largest response of a filter has a gradient.

    Embeddings start near zero, so that a word that was never met hardly
    responds. Words are dropped at random, so that no single one is relied on.
    """
    rng = np.random.default_rng(seed)
    offsets = sum(WIDTHS)
    net = Net(rng.normal(0, init, (3, BUCKETS, DIM)), rng.normal(0, 0.4, (DIM, offsets, FILTERS)), np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, len(WIDTHS) * FILTERS), -1.0)
    sizes = {"conv": net.conv.shape, "bias": net.bias.shape, "out": net.out.shape, "base": ()}
    moment = {k: (np.zeros(s), np.zeros(s)) for k, s in sizes.items()}
    e1, e2 = np.zeros_like(net.embed), np.zeros_like(net.embed)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            some = [texts[i][:, rng.random(texts[i].shape[1]) >= drop] for i in pick]
            ids = np.concatenate(some, 1)
            lengths = np.array([t.shape[1] for t in some])
            first = np.concatenate([[0], np.cumsum(lengths)])
            x = net.embed[0][ids[0]] + net.embed[1][ids[1]] + net.embed[2][ids[2]]
            part = x @ net.conv.reshape(DIM, -1)
            ends = np.repeat(first[1:], lengths)
            vs = net.responses(part, ends)
            best = np.zeros((len(pick), len(WIDTHS), FILTERS), np.int64)
            pooled = np.zeros((len(pick), len(WIDTHS) * FILTERS))
            for i in range(len(pick)):
                a, b = first[i], first[i + 1]
                if b > a:
                    for k, v in enumerate(vs):
                        best[i, k] = a + v[a:b].argmax(0)
                        pooled[i, k * FILTERS : (k + 1) * FILTERS] = v[best[i, k], np.arange(FILTERS)]
            act = np.maximum(pooled + net.bias, 0)
            z = act @ net.out + net.base
            dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) * weight[pick] / len(pick)
            dpre = dz[:, None] * net.out[None, :] * (pooled + net.bias > 0)
            dpre[lengths == 0] = 0
            g = {"out": act.T @ dz + 1e-4 * net.out, "base": dz.sum(), "bias": dpre.sum(0), "conv": np.zeros_like(net.conv)}
            rows, grads = [], []
            o = 0
            for k, w in enumerate(WIDTHS):
                d = dpre[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    at = best[:, k] + j
                    ok = (at < first[1:, None]) & (d != 0)
                    i, f = np.nonzero(ok)
                    pos, dv = at[i, f], d[i, f]
                    np.add.at(g["conv"].transpose(1, 2, 0), (o + j, f), dv[:, None] * x[pos])
                    rows.append(pos)
                    grads.append(dv[:, None] * net.conv[:, o + j, :].T[f])
                o += w
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            step += 1
            for k, gv in g.items():
                a, b = moment[k]
                a[...] = 0.9 * a + 0.1 * gv
                b[...] = 0.999 * b + 0.001 * np.square(gv)
                setattr(net, k, getattr(net, k) - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
            for t in range(3):  # of the embeddings only the rows in use move
                u, inv = np.unique(ids[t][rows], return_inverse=True)
                if not len(u):
                    continue
                ge = np.zeros((len(u), DIM))
                np.add.at(ge, inv, grads)
                e1[t][u] = 0.9 * e1[t][u] + 0.1 * ge
                e2[t][u] = 0.99 * e2[t][u] + 0.01 * ge * ge
                net.embed[t][u] -= rate * e1[t][u] / (np.sqrt(e2[t][u]) + 1e-6)
        rate *= 0.85
    net.base = float(net.base)
    return net


def calibrate(net: Net, texts: list[np.ndarray], y: np.ndarray) -> None:
    """Sets the threshold of each language where rows held back are told apart best, midway between their neighbours."""
    if not texts:
        return
    first = np.concatenate([[0], np.cumsum([t.shape[1] for t in texts])])
    ids = np.concatenate(texts, 1)
    z, lang = net.logits(ids, first, net.tables()), languages(ids, first)

    def best(z, y):
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        pos, neg = max(1, y.sum()), max(1, (1 - y).sum())
        # Cutting before each item: positives kept above, negatives left under.
        right = (y.sum() - np.concatenate([[0], np.cumsum(y)])) / pos + np.concatenate([[0], np.cumsum(1 - y)]) / neg
        ks = np.flatnonzero(right >= right.max() - 1e-12)
        edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        return float((edge[ks[0]] + edge[ks[-1] + 1]) / 2)

    everywhere = best(z, y)
    for k in range(len(LANGS)):
        own = lang == k
        net.shift[k] = best(z[own], y[own]) if (y[own] == 1).sum() >= 15 and (y[own] == 0).sum() >= 15 else everywhere


def _spread(ids: np.ndarray) -> np.ndarray:
    """All of a text's words, or FIT_RUNS runs of them that lie evenly over it and have FIT_WORDS in all."""
    n = ids.shape[1]
    if n <= FIT_WORDS:
        return ids
    run = FIT_WORDS // FIT_RUNS
    start = np.arange(FIT_RUNS) * (n - run) // (FIT_RUNS - 1)
    return ids[:, (start[:, None] + np.arange(run)[None, :]).ravel()]


def _ids(batches, key, text):
    for batch in batches:
        for piece in X.pieces(batch, text):
            ids, first = word_ids(*X.utf8(piece.column(text)))
            packed = [_spread(ids[:, a:b]).astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column("h"), pa.array(packed, pa.binary())], [key, "h", "v"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST, allowed=None) -> Net | None:
    """Fits on at most ``most`` rows of each label, a fifth of which only set the thresholds; None with fewer than two labels."""
    known = sample.labelled(labels, label, most, key, allowed)
    if not {0, 1} <= set(known.values()):
        return None
    rows = sample.features(docs, known, lambda b: _ids(b, key, text), key, text)
    texts = [np.frombuffer(v, np.uint16).reshape(3, -1).astype(np.int32) for _, v in rows]
    y = np.array([known[i] for i, _ in rows], np.int64)
    if not {0, 1} <= set(y.tolist()):
        return None
    held = np.arange(len(y)) % 5 == 4
    net = fit([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    calibrate(net, [t for t, h in zip(texts, held, strict=True) if h], y[held])
    return net


def _score(batches, key, text, net):
    tables = net.tables() if net else None
    for batch in batches:
        for piece in X.pieces(batch, text, X.PIECE):
            if net is None:
                score = np.zeros(piece.num_rows)
            else:
                score = net.scores(*word_ids(*X.utf8(piece.column(text))), tables)
            yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(np.round(score.astype(np.float64), 6))], [key, "score"])


def scored(docs: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, text).mapInArrow(lambda b: _score(b, key, text, net), f"`{key}` {dict(docs.dtypes)[key]}, score double")


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed=third != 1)
    held = F.coalesce(third == 1, F.lit(False))
    return scored(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
