"""Streams of documents: files as they arrive, and running tallies of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import office
from quire.sources.routing import media_type


def arriving(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Documents of Parquet files as they arrive under a path."""
    return spark.readStream.schema(schema).parquet(path)


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of office files as they arrive; those that no reader takes are rows with a refusal."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return office.nodes(files.where(media_type(F.col("content")).isin("zip", "rtf")))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of every line, without state."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "text"))


def running_tally(events: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, op, n): events by time, rows later than the watermark left out, state bounded by it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "op").agg(F.count("*").alias("n"))


def unique(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of the events of a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
