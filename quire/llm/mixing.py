"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, a water level turns weights into targets, the
ratio of target to size is the repetition rate, and each document is emitted
floor(rate) times plus one more time with the fraction as probability. The
draw is a hash of seed, id, text and a number among the rows that have both
alike, so that rows without ids, with one id, or that repeat are drawn apart,
and reruns agree on every machine. Rows that have a twin are numbered by runs,
those of one input partition, so no twin's rows meet in one task.

A null source is a source of its own, last in the order. A null text has size
0 and counts as empty. Which of several equal rows gets the copy depends on the
layout of the input, how many get one doesn't. A source without words
has target 0 and its documents are emitted no time. An empty table gives an
empty mix. Of the input's columns, those that are not named here are not read
by ``plan`` and are kept as they are by ``mix``; working columns begin with
``__quire_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm import store

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def n_words(text) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def draw(key, text_digest, number, seed: str = SEED) -> F.Column:
    """A number in [0, 1) from the first 48 bits of a SHA-256."""
    said = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), text_digest, number.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def numbered(rows: DataFrame, key: str, told: str, place: str, row: str) -> DataFrame:
    """rows with ``__quire_mix_number``: 0, 1 .. among those of one key and digest ``told``, by place and row.

    Only rows with a twin go through windows: one over the rows of a place, one
    over a row for each place.
    """
    twins = rows.groupBy(F.col(key).alias("__quire_mix_k"), F.col(told).alias("__quire_mix_t")).agg(F.count("*").alias("__quire_mix_n")).where("__quire_mix_n > 1").select("__quire_mix_k", "__quire_mix_t")
    twins = store.written(twins, "mix-twins")
    if not twins.limit(1).count():
        return rows.withColumn("__quire_mix_number", F.lit(0).cast("long"))
    same = F.col(key).eqNullSafe(F.col("__quire_mix_k")) & (F.col(told) == F.col("__quire_mix_t"))
    alone = rows.join(twins, same, "left_anti").withColumn("__quire_mix_number", F.lit(0).cast("long"))
    several = rows.join(twins, same, "left_semi")
    runs = several.groupBy(F.col(key).alias("__quire_mix_k"), F.col(told).alias("__quire_mix_t"), F.col(place).alias("__quire_mix_p")).agg(F.count("*").alias("n"))
    before = W.partitionBy("__quire_mix_k", "__quire_mix_t").orderBy("__quire_mix_p").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__quire_mix_from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy(key, told, place).orderBy(row)) - 1
    several = several.withColumn("__quire_mix_own", own).join(runs, same & (F.col(place) == F.col("__quire_mix_p")))
    return alone.unionByName(several.withColumn("__quire_mix_number", (F.col("__quire_mix_from") + F.col("__quire_mix_own")).cast("long")).select(*rows.columns, "__quire_mix_number"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources share ``share`` of all words by weight; a target stops at ``most``
    times its source's size and the excess goes to the others by weight. In
    order of the level at which each stops, those before the first that stays
    under its own stop are full. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("weight"))
    everything = W.partitionBy(F.lit(1))
    before = W.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Levels fall after the first source that isn't full, so the largest of those that hold is the first.
    level = F.max(F.when(F.col("stop") >= F.col("level"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def _rates(sizes: DataFrame, **how) -> DataFrame:
    """A written row for each source, which is small enough to know before the join."""
    goal = targets(sizes, **how).withColumnRenamed("source", "__quire_mix_source")
    return store.written(goal.withColumn("__quire_mix_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-rates")


def _copies(key, told, seed: str) -> F.Column:
    rate = F.col("__quire_mix_rate")
    return F.floor(rate) + (draw(key, told, F.col("__quire_mix_number"), seed) < rate - F.floor(rate)).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **how) -> DataFrame:
    """(key, size, source_size, target, copies) for every row; the texts are read once."""
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), digest(F.col(text)).alias("told"), F.spark_partition_id().alias("place"), F.monotonically_increasing_id().alias("row"))
    sizes = store.written(sizes, "mix-sizes")
    both = numbered(sizes, "key", "told", "place", "row").join(_rates(sizes, **how), F.col("source").eqNullSafe(F.col("__quire_mix_source")), "left")
    return both.select(F.col("key").alias(key), "size", "source_size", "target", _copies(F.col("key"), F.col("told"), seed).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **how) -> DataFrame:
    """The rows of docs, each as often as the plan says; columns and their order stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rates = _rates(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")), **how).select("__quire_mix_source", "__quire_mix_rate")
    rows = docs.withColumns({"__quire_mix_told": digest(F.col(text)), "__quire_mix_place": F.spark_partition_id(), "__quire_mix_row": F.monotonically_increasing_id()})
    both = numbered(rows, key, "__quire_mix_told", "__quire_mix_place", "__quire_mix_row").join(rates, F.col(source).eqNullSafe(F.col("__quire_mix_source")), "left")
    both = both.withColumn("__quire_mix_copy", F.explode(F.array_repeat(F.lit(1), _copies(F.col(key), F.col("__quire_mix_told"), seed).cast("int"))))
    return both.select(*names)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: {docs}: the relation that is mixed. Same operations in the same order, so that doubles agree.
PLAN_SQL = r"""
sizes AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
stops AS (SELECT *, cap / weight AS stop FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
  FROM stops WINDOW b AS (ORDER BY stop, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(cap, weight * coalesce(max(CASE WHEN stop >= level THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM levels),
rates AS (SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
told AS (SELECT *, sha256(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, sha256(coalesce(text, ''))) - 1 AS number FROM rates),
mixed AS (SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || number), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM told)
"""

OP4_SQL = "WITH " + PLAN_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
