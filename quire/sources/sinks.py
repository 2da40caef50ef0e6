"""Sinks: one canonical JSON record for each document, and Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import strings as S


def records(nodes: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, record, fingerprint): the nodes of a document as one canonical JSON text, and its SHA-256.

    Keys are in code-point order, numbers whole, escapes minimal, so that equal
    documents have equal bytes.
    """
    node = S.json_object({"id": S.json_string(F.concat(F.lit("e"), (F.col(order) + 1).cast("string"))), "kind": F.lit('"TextRun"'), "ordinal": (F.col(order) + 1).cast("string"), "text": S.json_string(F.col("text"))})
    per = nodes.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), node.alias("json")))).alias("n"))
    body = F.concat(F.lit("["), F.array_join(F.col("n.json"), ","), F.lit("]"))
    record = S.json_object({"nodes": body, "schema_version": F.lit('"1"')})
    return per.select(doc, record.alias("record"), F.sha2(body, 256).alias("fingerprint"))


def verify(recs: DataFrame, doc: str) -> DataFrame:
    """Records whose fingerprint isn't that of their nodes: empty in a sound store."""
    body = F.regexp_extract("record", r'(?s)^\{"nodes":(.*),"schema_version":"1"\}$', 1)
    return recs.where(F.sha2(body, 256) != F.col("fingerprint")).select(doc)


def write_records(recs: DataFrame, path: str) -> None:
    recs.select("record").write.mode("error").text(path)
