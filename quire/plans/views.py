"""Runs, words, boxes, cells and turns, derived from the tables of a folder.

Each view has a twin in SQL. A run is a line of a document with a place on a
page of forty lines; every fifth line is followed by a wider gap, and size and
indent follow the text, so that layout rules have something to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: A job is dealt to so many tasks at most.
MAX_TASKS = 20000
#: Bytes of order lines for one task, by Spark's estimate of the columns at hand.
CELL_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, task_bytes: int) -> int:
    """As many tasks as cores, and as df has ``task_bytes`` by Spark's own estimate, so that a task doesn't grow with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(max(-(-size // task_bytes), least), MAX_TASKS)


def dealt(df: DataFrame, task_bytes: int, *keys) -> DataFrame:
    """df dealt by keys to ``tasks``."""
    return df.repartition(tasks(df, task_bytes), *keys)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, page, text, x0, y0, x1, y1, em, bold: one row for each line of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "text"))
    n = F.length("text")
    on = F.col("ord") % 40
    return docs.select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.expr("ord div 40 + 1").cast("bigint").alias("page"),
        "text",
        (7200 + (F.col("ord") % 4) * 300).cast("bigint").alias("x0"),
        (7200 + on * 1200 + F.floor(on / 5) * 900).cast("bigint").alias("y0"),
        (7200 + (F.col("ord") % 4) * 300 + n * 500).cast("bigint").alias("x1"),
        (8200 + on * 1200 + F.floor(on / 5) * 900).cast("bigint").alias("y1"),
        (F.when(n % 11 == 0, 1604).when(n % 5 == 0, 1197).otherwise(1003)).cast("bigint").alias("em"),
        (n % 7 == 0).alias("bold"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, w, text, x0, x1, y0: the words of each run, set one after the other; wide gaps before every fourth."""
    r = runs(spark, sf_dir).select("doc_id", "ord", "y0", F.posexplode(F.split("text", " ", -1)).alias("w", "text"))
    before = W.partitionBy("doc_id", "ord").orderBy("w").rowsBetween(W.unboundedPreceding, -1)
    x0 = 7200 + F.coalesce(F.sum(F.length("text") * 500 + 300 + F.when((F.col("w") + 1) % 4 == 0, 1500).otherwise(0)).over(before), F.lit(0))
    r = r.withColumn("x0", x0.cast("bigint"))
    return r.select("doc_id", "ord", F.col("w").cast("bigint").alias("w"), "text", "x0", (F.col("x0") + F.length("text") * 500).cast("bigint").alias("x1"), "y0")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, x0, y0, x1, y1: four components of each embedding as a box, twenty to a page; some have no area."""
    e = table(spark, sf_dir, "embeddings")
    q = lambda i, k: F.floor(F.element_at("embedding", i).cast("double") * k).cast("bigint")
    e = e.select(F.expr("vec_id div 20").alias("page"), F.col("vec_id").alias("id"), (30000 + q(1, 100000)).alias("x0"), (30000 + q(2, 100000)).alias("y0"), q(3, 20000).alias("w"), q(4, 20000).alias("h"))
    return e.select("page", "id", "x0", "y0", (F.col("x0") + F.col("w") + 1500).alias("x1"), (F.col("y0") + F.col("h") + 1500).alias("y1"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, cell, r, c, rowspan, colspan, text: order lines as cells of tables of eight orders; some span, some collide."""
    x = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 8").alias("tbl"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"))
    # Dealt once, by table: cells and slots are then grouped where they are, and a task's groups don't grow with the input.
    x = dealt(x, CELL_BYTES, "tbl").groupBy("tbl", "l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("supp"), F.sum("qty").alias("qty"))
    return x.select(
        "tbl",
        F.concat_ws(":", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("cell"),
        (F.col("l_orderkey") % 8).cast("bigint").alias("r"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("c"),
        F.when(F.col("qty") % 10 == 0, 2).otherwise(1).cast("bigint").alias("rowspan"),
        F.when(F.col("qty") % 7 == 0, 2).otherwise(1).cast("bigint").alias("colspan"),
        F.col("qty").cast("string").alias("text"),
    )


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, op, text_bytes, rectangle: what a page draws, one row for each event; users are documents, hours pages."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 13 == 0, "image").when(F.col("event_id") % 5 == 0, "path").when(F.col("event_id") % 29 == 0, "annotation").otherwise("text")
    return e.select(F.col("user_id").alias("doc"), (F.col("event_id") % 8 + 1).cast("bigint").alias("page"), F.when(F.col("user_id") % 3 == 0, F.when(op == "text", "path").otherwise(op)).otherwise(op).alias("op"), F.length("event_type").cast("bigint").alias("text_bytes"), (F.col("event_id") % 2 == 0).alias("rectangle"))


SQL = {
    "runs": """runs AS (SELECT doc_id, ord, ord // 40 + 1 AS page, text, 7200 + (ord % 4) * 300 AS x0, 7200 + (ord % 40) * 1200 + (ord % 40) // 5 * 900 AS y0,
  7200 + (ord % 4) * 300 + length(text) * 500 AS x1, 8200 + (ord % 40) * 1200 + (ord % 40) // 5 * 900 AS y1,
  CASE WHEN length(text) % 11 = 0 THEN 1604 WHEN length(text) % 5 = 0 THEN 1197 ELSE 1003 END::BIGINT AS em, length(text) % 7 = 0 AS bold
  FROM (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1)::BIGINT - 1 AS ord FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)))""",
    "words": """words AS (SELECT doc_id, ord, w, text, x0, x0 + length(text) * 500 AS x1, y0 FROM (
  SELECT *, 7200 + coalesce(sum(length(text) * 500 + 300 + CASE WHEN (w + 1) % 4 = 0 THEN 1500 ELSE 0 END) OVER (PARTITION BY doc_id, ord ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x0
  FROM (SELECT doc_id, ord, y0, unnest(t) AS text, generate_subscripts(t, 1)::BIGINT - 1 AS w FROM (SELECT doc_id, ord, y0, string_split(text, ' ') AS t FROM runs))))""",
    "boxes": """boxes AS (SELECT page, id, x0, y0, x0 + w + 1500 AS x1, y0 + h + 1500 AS y1 FROM (SELECT vec_id // 20 AS page, vec_id AS id, 30000 + floor(embedding[1]::DOUBLE * 100000)::BIGINT AS x0,
  30000 + floor(embedding[2]::DOUBLE * 100000)::BIGINT AS y0, floor(embedding[3]::DOUBLE * 20000)::BIGINT AS w, floor(embedding[4]::DOUBLE * 20000)::BIGINT AS h FROM embeddings))""",
    "cells": """cells AS (SELECT l_orderkey // 8 AS tbl, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS cell, (l_orderkey % 8)::BIGINT AS r, (l_linenumber - 1)::BIGINT AS c,
  CASE WHEN qty % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS rowspan, CASE WHEN qty % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS colspan, qty::VARCHAR AS text
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS supp, sum(l_quantity::BIGINT)::BIGINT AS qty FROM lineitem GROUP BY ALL))""",
    "page_facts": """page_facts AS (SELECT doc, page, CASE WHEN doc % 3 = 0 AND op = 'text' THEN 'path' ELSE op END AS op, text_bytes, rectangle FROM (SELECT user_id AS doc, (event_id % 8 + 1)::BIGINT AS page,
  CASE WHEN event_id % 13 = 0 THEN 'image' WHEN event_id % 5 = 0 THEN 'path' WHEN event_id % 29 = 0 THEN 'annotation' ELSE 'text' END AS op, length(event_type)::BIGINT AS text_bytes, event_id % 2 = 0 AS rectangle FROM events))""",
}
_NEEDS = {"words": ("runs",)}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause of these views and of those that they need; the query goes on after its comma-free end."""
    order: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in order:
                order.append(m)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order)
