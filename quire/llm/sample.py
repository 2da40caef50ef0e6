"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label values at most.
VALUES = 64


def labelled(labels: DataFrame, value: str, most: int, key: str = "doc_id", where: Column | None = None, seed: str = "fit-1") -> dict:
    """{id: label} of at most ``most`` labelled rows of each label value, those with the least hashes.

    The same rows are taken at every size and on every run. Null ids and null
    labels are left out; of several labels for one id the largest counts. Only
    ids and labels reach the driver, ``most`` for each of the label's values;
    more than VALUES of those are an error.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.max(value).alias("label"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    out: dict = {}
    values = sorted(rows.select("label").distinct().limit(VALUES + 1).collect())
    if len(values) > VALUES:
        raise ValueError(f"{value} has over {VALUES} values")
    for (x,) in values:
        out |= {r["id"]: x for r in rows.where(F.col("label") == x).orderBy("h", "id").limit(most).collect()}
    return out


def features(docs: DataFrame, known: dict, vectors, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """(id, buffer of the vector) of the sampled ids, in order. vectors: batches of (key, text, h) -> batches of (key, h, v).

    Of several rows with one id the one whose text has the least hash counts,
    and copies of an id's texts are merged before the shuffle, so the driver gets
    one vector for each id. The broadcast side has as many rows as the sample's
    bound.
    """
    if not known:
        return []
    kind = dict(docs.dtypes)[key]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in known], f"__id {kind}")
    rows = docs.select(key, text, F.xxhash64(F.col(text)).alias("h")).join(F.broadcast(wanted), F.col(key) == F.col("__id"), "left_semi")
    rows = rows.mapInArrow(vectors, f"`{key}` {kind}, h bigint, v binary").groupBy(key).agg(F.min_by("v", "h").alias("v"))
    table = rows.toArrow()
    return sorted(((i, v.as_buffer()) for i, v in zip(table.column(0).to_pylist(), table.column(1), strict=True)), key=lambda r: r[0])
