"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A text becomes one hashed vector: shares of byte trigrams (letters in lower
case), shares of four-byte shapes, and shares of repeated words and lines. One
weight vector is shared by all grades; ordered thresholds cut the line into
grades, P(grade <= k) = sigmoid(t_k - w.x). The model gives the expected grade
and the tail probability of the upper grades, on which documents are selected.

The model is fitted on the driver from a bounded sample of labelled rows
(MOST of each grade); every document is then scored over its whole text, on
the executors, with a model of fixed size.

Null and empty texts have a zero vector and get the score of the thresholds
alone; they are rejected by the text rule (no word, no document). With one
grade in the labels, or none, everything with a word is kept. Repeated rows
score alike; other columns are not looked at. Of several texts with one rated
id one is fitted on. Very long texts are one vector like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import sample, store
from quire.llm import text as X

#: Labelled rows of each grade that are fitted on, at most.
MOST = 1500
TRIGRAMS, SHAPES, REPEATS = 2048, 1024, 4
SIZE = TRIGRAMS + SHAPES + REPEATS
#: A document goes when the tail probability of the upper grades is under this.
KEEP = 0.5

_SHAPE = np.zeros(256, np.uint32)
_SHAPE[:] = np.arange(256)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4


def _indices(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram, and of the shape, that begins at each byte."""
    b = np.concatenate([X.LOWER[buf], np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(buf)
    tri = b[:n] * np.uint32(0x9E3779B1) ^ b[1 : n + 1] * np.uint32(0x85EBCA77) ^ b[2 : n + 2] * np.uint32(0xC2B2AE3D)
    tri = (tri * np.uint32(0x27D4EB2F)) >> np.uint32(21)
    s = _SHAPE[np.concatenate([buf, np.zeros(3, np.uint8)])]
    shape = s[:n] * np.uint32(0x9E3779B1) ^ s[1 : n + 1] * np.uint32(0x85EBCA77) ^ s[2 : n + 2] * np.uint32(0xC2B2AE3D) ^ s[3 : n + 3] * np.uint32(0x165667B1)
    shape = (shape * np.uint32(0x27D4EB2F)) >> np.uint32(22)
    return tri.astype(np.int64), shape.astype(np.int64)


def _repeats(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text: shares of words equal to the one before, words without a letter, capital bytes, bytes in signs."""
    start, end, first = X.words(buf, off)
    h = X.word_hashes(buf, start, end)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    n = np.maximum(np.diff(first), 1)
    letter = (buf >= 128) | (X.LOWER[buf] >= 97) & (X.LOWER[buf] <= 122)
    sums = np.concatenate([[0], np.cumsum(letter)])
    bare = sums[end] == sums[start]
    of = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    size = np.maximum(np.diff(off), 1)
    upper = (buf >= 65) & (buf <= 90)
    signs = ~letter & ~X.WHITE[buf] & ~((buf >= 48) & (buf <= 57)) & (buf != 46) & (buf != 44)
    return np.stack([of(same, first) / n, of(bare, first) / n, of(upper, off) / size, of(signs, off) / size], 1)


def vectors(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Dense vectors, for fitting."""
    n = len(off) - 1
    out = np.zeros((n, SIZE), np.float32)
    tri, shape = _indices(buf)
    for i in range(n):
        a, b = off[i], off[i + 1]
        if b > a:
            out[i, :TRIGRAMS] = np.bincount(tri[a:b], minlength=TRIGRAMS) / (b - a)
            out[i, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(shape[a:b], minlength=SHAPES) / (b - a)
    out[:, TRIGRAMS + SHAPES :] = _repeats(buf, off)
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]
    #: Mean line of the upper grade. So many bytes of it count with every text, as a few words say little.
    usual: float = 0.0
    usual_bytes: int = 64

    def line(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """w.x of each text, without its vector: every byte adds the weights of what begins there."""
        tri, shape = _indices(buf)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[tri] + self.weights[TRIGRAMS + shape])])
        size = np.diff(off)
        own = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(size, 1) + _repeats(buf, off) @ self.weights[TRIGRAMS + SHAPES :]
        return (own * size + self.usual * self.usual_bytes) / (size + self.usual_bytes)

    def judge(self, line: np.ndarray, tail_from: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of the grades from the ``tail_from``-th on."""
        above = 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds[None, :], -40, 40)))
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + above @ steps, above[:, min(tail_from, above.shape[1]) - 1]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4, own: bool = False) -> Model | None:
    """Cumulative-link regression by full-batch Adam; None with fewer than two grades.

    Grades weigh alike, so that rare ones count. Thresholds are the first and
    the logarithms of the steps between them, which keeps them in order. ``x`` is
    scaled and centred in place if it is ``own``, so that the driver holds it once.
    """
    grades = sorted({int(v) for v in y})
    if len(grades) < 2:
        return None
    k = np.searchsorted(grades, y)
    m = len(grades) - 1
    scale = 1 / np.sqrt(x.mean(0) * 0.05 + 1e-5)
    xs = x if own else x.copy()
    xs *= scale
    centre = xs.mean(0)
    xs -= centre
    share = np.bincount(k, minlength=m + 1)
    each = (1 / (share[k] * (m + 1))).astype(np.float32)
    p = np.zeros(x.shape[1] + m)
    p[x.shape[1]] = -0.5 * (m - 1)
    first, second = np.zeros_like(p), np.zeros_like(p)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for t in range(1, rounds + 1):
        w, a = p[: x.shape[1]], p[x.shape[1] :]
        steps = np.exp(a[1:])
        th = a[0] + np.concatenate([[0.0], np.cumsum(steps)])
        line = xs @ w.astype(np.float32)
        upper = np.where(k < m, sig(th[np.minimum(k, m - 1)] - line), 1.0)
        lower = np.where(k > 0, sig(th[np.maximum(k - 1, 0)] - line), 0.0)
        prob = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / prob * each, lower * (1 - lower) / prob * each
        g = np.zeros_like(p)
        g[: x.shape[1]] = xs.T @ (du - dl).astype(np.float32) + ridge * w
        gth = np.array([-(du[k == j].sum()) + dl[k == j + 1].sum() for j in range(m)])
        g[x.shape[1]] = gth.sum()
        for j in range(1, m):
            g[x.shape[1] + j] = gth[j:].sum() * steps[j - 1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    w, a = p[: x.shape[1]], p[x.shape[1] :]
    th = a[0] + np.concatenate([[0.0], np.cumsum(np.exp(a[1:]))])
    upper = (k == m).astype(np.float32) @ xs / max(share[m], 1) + centre
    return Model(w * scale, th + float(centre @ w), grades, float(upper @ w))


def _vectors(batches, key, text):
    for batch in batches:
        for piece in X.pieces(batch, text):
            v = vectors(*X.utf8(piece.column(text))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column("h"), pa.array([r.tobytes() for r in v], pa.binary())], [key, "h", "v"])


def train(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "quality", most: int = MOST) -> Model | None:
    """Fits on at most ``most`` rated documents of each grade; their vectors (6 kB each) reach the driver, no text does."""
    known = sample.labelled(ratings, grade, most, key)
    if len(set(known.values())) < 2:
        return None
    rows = sample.features(docs, known, lambda b: _vectors(b, key, text), key, text)
    x = np.empty((len(rows), SIZE), np.float32)
    for k, (_, v) in enumerate(rows):
        x[k] = np.frombuffer(v, np.float16)
    y = np.array([known[i] for i, _ in rows], np.int64)
    del rows
    store.release(docs.sparkSession)
    return fit(x, y, own=True)


def judge_batches(batches, keep: list[str], text: str, model: Model | None, names: list[str]):
    for batch in batches:
        for piece in X.pieces(batch, text):
            buf, off = X.utf8(piece.column(text))
            has = np.diff(X.words(buf, off)[2]) > 0
            if model is None:
                grade, tail = np.zeros(len(has)), np.ones(len(has))
            else:
                grade, tail = model.judge(model.line(buf, off))
            tail = np.where(has, tail, 0.0)
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array(np.round(grade, 6)), pa.array(np.round(tail, 6)), pa.array(has & (tail >= KEEP))], names)


def judged(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them if None) with __grade, __tail and __kept."""
    keep = keep or docs.columns
    needed = list(dict.fromkeys([*keep, text]))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "__quire_grade double, __quire_tail double, __quire_kept boolean"])
    names = [*keep, "__quire_grade", "__quire_tail", "__quire_kept"]
    return docs.select(*(f"`{k}`" for k in needed)).mapInArrow(lambda b: judge_batches(b, keep, text, model, names), schema)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, model, keep=["doc_id"]).select("doc_id", F.col("__quire_grade").alias("expected_grade"), F.col("__quire_tail").alias("tail_prob"), F.col("__quire_kept").alias("kept"))
