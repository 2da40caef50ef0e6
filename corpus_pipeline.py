"""A training corpus from documents: five stages, each a table in the shared folder.

Quality classifier, n-gram Jaccard join (one document of each group stays),
benchmark decontamination, mixing of sources to target weights, sharding. Every
stage works on all rows that the one before kept; all but the last return the
columns of documents. Each function's docstring says what it decides; nulls, empty
and very long texts, repeated rows and empty tables fare as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, mixing, quality, sharding, store


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the upper grades reaches quality.KEEP."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, model).where(F.col("__quire_kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 hold together."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard_id, shards of sharding.OP9_LIMIT bytes at most."""
    return sharding.shard(docs, limit=sharding.OP9_LIMIT)


STAGES = [
    ("quality_classifier", select_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: SQL can't express the fitted classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
