"""Quality rules by robust multivariate outliers.

Each text gives counts; the counts give a transformed vector of six statistics;
each group (language and source) gets a minimum-covariance-determinant estimate
of place and scatter; a text whose squared Mahalanobis distance goes over the
cut is rejected, as is one that fails the base rule.

The estimate is looked for from three starts: medians and quartile ranges; the
covariance of rows that are clipped to the middle; the spatial signs. From each,
concentration steps: distances under the present estimate pick the half of the
rows that lies closest, whose mean and covariance are the next estimate. After
TRIES steps the start with the least determinant of each group goes on until
the determinants fall no longer, up to STEPS; the least one met is the estimate. Every step
is an aggregation over all rows by (group, bin of distance), so that no group is
brought together in one task; the closest half is the fewest whole bins (of
1 %) that hold half of the rows. Statistics are whole thousandths, so sums are
exact and reruns agree bit for bit. Texts are read once.

Every language and source has an estimate of its own. PRIOR rows' worth of its
language's estimate count with it, which steadies small groups and is nothing in
large ones; the languages' are found in the same way, with the quartile ranges
of all rows in that place. Null
languages and sources are values of their own. Null and empty texts have no
words and fail the base rule. Very long texts count as one row, whole. Rows that
repeat count each. An empty table gives an empty result. Ids may repeat or be
null; other columns are not looked at. Words, windows and lines are told by
64-bit hashes (``quire.llm.text``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm import store
from quire.llm import text as X

#: Rows' worth of the estimate of what a group belongs to that count with its own rows.
PRIOR = 20
#: Share of rows whose scatter is estimated.
HALF = 0.5
#: Concentration steps of every start, and of the best one.
TRIES, STEPS = 2, 8
#: A fall of a logarithmic determinant under this is none.
SAME = 1e-3
#: Bins of distance for each doubling.
BINS = 64
#: Thousandths in a unit of a direction's coordinates; standard deviations to which rows are clipped.
UNIT, CLIP = 1000, 1.5
#: Smallest standard deviation of each statistic, in thousandths: closer differences count as none.
FLOOR = (500, 60, 60, 120, 60, 30)
#: Probability under the reference distribution beyond which a text is an outlier.
CUT = 0.99999

P = 6
NAMES = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its document has an equal one before it, and whether it has another at all."""
    order = np.lexsort((h, doc))  # stable: equal ones stay in their order
    d, k = doc[order], h[order]
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        same[1:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    before, any_other = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[order] = same[:-1]
    any_other[order] = same[:-1] | same[1:]
    return before, any_other


def count_texts(buf: np.ndarray, off: np.ndarray, span: int = 5) -> dict[str, np.ndarray]:
    """COUNTS for each text."""
    n = len(off) - 1
    start, end, first = X.words(buf, off)
    n_words = np.diff(first)
    solid = ~X.WHITE[buf]
    out = {"n_words": n_words, "word_chars": _per_text(solid & ((buf & 0xC0) != 0x80), off), "n_symbols": _per_text(_SYMBOL[buf], off), "n_upper": _per_text((buf >= 65) & (buf <= 90), off)}
    values = X.BYTE[buf]
    sums = X.prefix_sums(values)
    doc = np.repeat(np.arange(n), n_words)
    # Windows of `span` words that are found twice or more, and the words under them.
    h = X.tree_hash(values, start, end, sums)
    grams = X.prefix_sums(h)
    at = np.arange(max(0, len(h) - span + 1))
    at = at[doc[at] == doc[at + span - 1]] if len(at) else at
    _, twice = _again(doc[at], X.range_hash(grams, at, at + span))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + span, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, first)
    # Lines with a word, equal to an earlier one.
    feeds = np.flatnonzero(buf == 10)
    line = np.unique(np.concatenate([off[:-1], feeds + 1]))
    line = line[line < len(buf)]
    stop = np.minimum(np.append(feeds, len(buf))[np.searchsorted(feeds, line)], off[np.searchsorted(off, line, "right")])
    has = np.searchsorted(start, line) < np.searchsorted(start, stop)
    line, stop = line[has], stop[has]
    of = np.searchsorted(off, line, "right") - 1
    before, _ = _again(of, X.tree_hash(values, line, stop, sums))
    out["n_dup_lines"] = np.bincount(of[before], minlength=n)
    out["n_lines"] = np.bincount(of, minlength=n)
    return out


def _counted(batches, keep, text):
    fields = [*keep, *COUNTS]
    for batch in batches:
        for piece in X.pieces(batch, text):
            buf, off = X.utf8(piece.column(text))
            counts = count_texts(buf, off)
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], fields)


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    schema = ", ".join([*(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep), *(f"{c} bigint" for c in COUNTS)])
    return docs.select(*keep, text).mapInArrow(lambda b: _counted(b, keep, text), schema)


def _vector() -> list[F.Column]:
    """The transformed statistics in thousandths: log length, log mean word, symbols, repeated lines and words, capitals.

    Shares of short texts vary by chance; a fixed number of typical words or
    lines is added to each, so that they are drawn towards the usual.
    """
    words, chars = F.col("n_words") + 100, F.col("word_chars") + 500
    raw = (F.log1p("n_words"), F.log(chars / words), F.log1p(F.col("n_symbols") / (F.col("n_words") + 20)), F.col("n_dup_lines") / (F.col("n_lines") + 2), F.col("n_repeat_words") / (F.col("n_words") + 20), (F.col("n_upper") + 15) / chars)
    return [F.round(x * 1000).cast("long").alias(n) for x, n in zip(raw, NAMES, strict=True)]


def chi2_cdf(x, p: int):
    """For an even number of degrees."""
    return 1 - np.exp(-np.asarray(x) / 2) * sum((np.asarray(x) / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q, p: int) -> np.ndarray:
    q = np.asarray(q, float)
    lo, hi = np.zeros_like(q), np.full_like(q, 1000.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = chi2_cdf(mid, p) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo


def _distance() -> F.Column:
    """Squared Mahalanobis distance under the columns m0.. and s00.."""
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"s{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


PARAMS = "grp string, start int, fall double, logdet double, " + ", ".join(f"m{i} double, p{i} double" for i in range(P)) + ", " + ", ".join(f"s{i}{j} double, e{i}{j} double" for i, j in PAIRS)
#: What a group belongs to: place and scatter.
_PRIOR = [f"p{i}" for i in range(P)] + [f"e{i}{j}" for i, j in PAIRS]
_PARAMS = [x.split()[0] for x in PARAMS.split(", ")]


def _rows(pdf: pd.DataFrame, mean: np.ndarray, cov: np.ndarray, before: np.ndarray) -> pd.DataFrame:
    """PARAMS of the groups and starts of pdf; before: the determinants' logarithms that theirs are compared with."""
    inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    out = {"grp": pdf["grp"].to_numpy(), "start": pdf["start"].to_numpy(), "fall": before - logdet, "logdet": logdet}
    for i in range(P):
        out |= {f"m{i}": mean[:, i], f"p{i}": pdf[f"p{i}"].to_numpy()}
    for i, j in PAIRS:
        out |= {f"s{i}{j}": inverse[:, i, j], f"e{i}{j}": pdf[f"e{i}{j}"].to_numpy()}
    return pd.DataFrame(out)[_PARAMS]


def _columns(pdf: pd.DataFrame, letter: str) -> np.ndarray:
    return np.stack([pdf[f"{letter}{i}"].to_numpy(float) for i in range(P)], 1)


def _matrices(pdf: pd.DataFrame, letter: str) -> np.ndarray:
    out = np.empty((len(pdf), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = pdf[f"{letter}{i}{j}"].to_numpy(float)
    return out


def _moments(pdf: pd.DataFrame, letter: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products, a row for each group."""
    return _columns(pdf, letter), _matrices(pdf, letter)


def _diagonal(sd: np.ndarray) -> np.ndarray:
    return np.square(sd)[..., None] * np.eye(P)


def steadied(n: np.ndarray, mean: np.ndarray, cov: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scatters of n rows each, with the prior's."""
    n = np.asarray(n, float)[:, None]
    return (n * mean + PRIOR * centre) / (n + PRIOR), (n[..., None] * cov + PRIOR * scatter) / (n[..., None] + PRIOR) + _diagonal(np.array(FLOOR, float)) / 4


def starts(sd: np.ndarray, clipped: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """The scatters that concentration begins with; clipped: covariances of clipped rows; signs: mean products of directions."""
    return [_diagonal(sd), clipped + _diagonal(sd) / 4, P * sd[:, :, None] * signs * sd[:, None, :] + _diagonal(sd) / 16]


def _start(batches):
    """Each group's starts, from its quartiles and the sums over clipped rows and directions."""
    for pdf in batches:
        low, median, high, centre = (_columns(pdf, c) for c in "abhp")
        sd = np.maximum((high - low) / 1.349, FLOOR)
        n = pdf["n"].to_numpy(float)
        one, two = _moments(pdf, "c")
        _, signs = _moments(pdf, "u")
        mean = one / n[:, None]
        for k, cov in enumerate(starts(sd, two / n[:, None, None] - mean[:, :, None] * mean[:, None, :], signs / n[:, None, None] / UNIT**2)):
            yield _rows(pdf.assign(start=k), *steadied(n, median, cov, centre, _matrices(pdf, "e")), np.full(len(pdf), math.inf))


def concentrated(n: np.ndarray, m: np.ndarray, one: np.ndarray, two: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next estimates from the sums over the m closest of n rows."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    mean = one / m[:, None]
    cov = two / m[:, None, None] - mean[:, :, None] * mean[:, None, :]
    share = m / n  # what the closest rows of a normal cloud understate
    factor = np.where(share < 1, share / np.maximum(chi2_cdf(chi2_quantile(np.minimum(share, 1 - 1e-9), P), P + 2), 1e-9), 1.0)
    return steadied(n, mean, cov * factor[:, None, None], centre, scatter)


def half(n):
    """Rows of a subset: the least number over half. The prior keeps the scatter of the smallest ones regular."""
    return F.floor(n * HALF) + 1 if isinstance(n, F.Column) else math.floor(n * HALF) + 1


def _concentrate(batches):
    """The next estimates, from the sums over each group's closest half."""
    for pdf in batches:
        mean, cov = concentrated(pdf["n"].to_numpy(float), pdf["m"].to_numpy(float), *_moments(pdf, "t"), _columns(pdf, "p"), _matrices(pdf, "e"))
        yield _rows(pdf, mean, cov, pdf["logdet"].to_numpy(float))


def _sums(letter: str, values: list[F.Column]) -> list[F.Column]:
    return [F.sum(v).alias(f"{letter}{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"{letter}{i}{j}") for i, j in PAIRS]


def _step(vectors: DataFrame, params: DataFrame) -> DataFrame:
    near = vectors.join(params, "grp").withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int"))
    # Written in between, so that partial sums meet by group and bin, not all of a group in one task.
    bins = store.written(near.groupBy("grp", "start", "bin").agg(F.count("*").alias("k"), *_sums("t", [F.col(x) for x in NAMES])), "mcd-bins")
    group = W.partitionBy("grp", "start")  # a few thousand bins each
    before = F.coalesce(F.sum("k").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("before", before).withColumn("n", F.sum("k").over(group)).where(F.col("before") < half(F.col("n")))
    names = [f"t{i}" for i in range(P)] + [f"t{i}{j}" for i, j in PAIRS]
    sums = inner.groupBy("grp", "start").agg(F.first("n").alias("n"), F.sum("k").alias("m"), *(F.sum(x).alias(x) for x in names))
    told = sums.join(params.select("grp", "start", "logdet", *_PRIOR), ["grp", "start"])
    return store.written(told.mapInPandas(_concentrate, PARAMS), "mcd")


def _quartiles(letter: str) -> list[F.Column]:
    return [F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{letter}{i}") for i, n in enumerate(NAMES)]


def _begin(vectors: DataFrame, prior: DataFrame) -> DataFrame:
    """All starts of each group. prior: _PRIOR of each kin."""
    own = vectors.groupBy("grp").agg(F.first("kin").alias("kin"), *_quartiles("q")).join(prior, "kin")
    quart = store.written(own.select("grp", *(F.col(f"q{i}")[k].alias(f"{c}{i}") for k, c in enumerate("abh") for i in range(P)), *_PRIOR), "mcd-quartiles")
    sd = [F.greatest((F.col(f"h{i}") - F.col(f"a{i}")) / 1.349, F.lit(float(FLOOR[i]))) for i in range(P)]
    z = [(F.col(f"x{i}") - F.col(f"b{i}")) / sd[i] for i in range(P)]
    size = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    clipped = [F.round(F.col(f"b{i}") + sd[i] * F.least(F.greatest(z[i], F.lit(-CLIP)), F.lit(CLIP))).cast("long") for i in range(P)]
    both = vectors.join(quart, "grp").select("grp", *(c.alias(f"cx{i}") for i, c in enumerate(clipped)), *(F.round(v / size * UNIT).cast("long").alias(f"ux{i}") for i, v in enumerate(z)))
    sums = both.groupBy("grp").agg(F.count("*").alias("n"), *_sums("c", [F.col(f"cx{i}") for i in range(P)]), *_sums("u", [F.col(f"ux{i}") for i in range(P)]))
    return store.written(sums.join(quart, "grp").mapInPandas(_start, PARAMS), "mcd")


def estimated(vectors: DataFrame, prior: DataFrame) -> DataFrame:
    """PARAMS, a row for each group of (grp, kin, x0..x5); prior: (kin, _PRIOR)."""
    params = _begin(vectors, prior)
    for _ in range(TRIES):
        params = _step(vectors, params)
    least = F.min_by(F.struct(*_PARAMS), F.struct("logdet", "start")).alias("b")
    met = params = store.written(params.groupBy("grp").agg(least).select("b.*"), "mcd")
    for _ in range(STEPS - TRIES):
        params = _step(vectors, params)
        met = met.unionByName(params)
        if (params.agg(F.max("fall")).first()[0] or 0.0) < SAME:
            break
    return store.written(met.groupBy("grp").agg(least).select("b.*"), "mcd")


def _as_prior(batches):
    """The estimates of languages, as what their groups belong to."""
    for pdf in batches:
        cov = np.linalg.inv(_matrices(pdf, "s"))
        yield pd.DataFrame({"kin": pdf["grp"]} | {f"p{i}": pdf[f"m{i}"] for i in range(P)} | {f"e{i}{j}": cov[:, i, j] for i, j in PAIRS})


def all_rows(quartiles: list) -> dict[str, float]:
    """_PRIOR of the languages, from the quartiles of all rows."""
    sd = [max((q[2] - q[0]) / 1.349, FLOOR[i]) if q else FLOOR[i] for i, q in enumerate(quartiles)]
    return {f"p{i}": float(q[1]) if q else 0.0 for i, q in enumerate(quartiles)} | {f"e{i}{j}": float(sd[i] ** 2) if i == j else 0.0 for i, j in PAIRS}


def fit(vectors: DataFrame) -> DataFrame:
    """PARAMS, a row for each group of (grp, language, x0..x5)."""
    spark = vectors.sparkSession
    first = all_rows(list(vectors.agg(*_quartiles("q")).first()))
    schema = "kin string, " + ", ".join(f"{c} double" for c in _PRIOR)
    first = spark.createDataFrame([("", *(first[c] for c in _PRIOR))], schema)
    languages = estimated(vectors.select(F.col("language").alias("grp"), F.lit("").alias("kin"), *NAMES), first)
    return estimated(vectors.select("grp", F.col("language").alias("kin"), *NAMES), store.written(languages.mapInPandas(_as_prior, schema), "mcd-prior"))


def grouped(stats: DataFrame) -> DataFrame:
    """stats with grp, language and source, and with language."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    return stats.withColumn("grp", F.concat_ws("\t", lang, source)).withColumn("language", lang)


def reject_outliers(docs: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, the counts, base_failed, distance and kept for every row of docs (doc_id, lang, source, text)."""
    stats = store.written(counts(docs, text), "text-counts")
    vectors = store.written(grouped(stats).select("*", *_vector()), "text-vectors")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    params = fit(vectors.where(~base).select("grp", "language", *NAMES))
    both = vectors.join(params, "grp", "left").withColumn("distance", _distance()).withColumn("base_failed", base)
    inside = F.coalesce(F.col("distance") <= float(chi2_quantile(cut, P)), F.lit(True))
    return both.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & inside).alias("kept"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return reject_outliers(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
