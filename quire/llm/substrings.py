"""Substring deduplication: by column-wise suffix sorting (bytes), and by an FM-index (words).

Both work on the repeats of ``quire.llm.repeats``, which brings equal windows
into one shard; the shard's index finds them there.

Null and empty texts have no symbol and lose nothing. Rows with one id are one
place in the order for words (neither is smaller) and follow each other for
bytes. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bwt, fmindex, repeats
from quire.llm import text as X


def repeated_by_suffixes(strings: np.ndarray, lengths: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """Windows that are equal to one that begins earlier, from the common prefixes of the sorted suffixes."""
    _, common, place = bwt.collection_bwt(strings, lengths)
    string = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    group = np.cumsum(common < window)
    place = place.astype(np.int64)
    own = string[place]
    offset = place - begin[own]
    full = lengths[own] - offset >= window
    group, own, offset = group[full], own[full], offset[full]
    order = np.lexsort((pos[own] + offset, tie[own], doc[own], group))
    again = np.zeros(len(order), bool)
    again[1:] = group[order][1:] == group[order][:-1]
    count = lengths - window + 1
    gone = np.zeros(int(count.sum()), bool)
    gone[(np.cumsum(count) - count)[own[order]] + offset[order]] = again
    return gone


def repeated_by_index(strings: np.ndarray, lengths: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """Windows whose matching statistic against the documents of smaller id reaches the threshold."""
    alphabet, codes = np.unique(strings, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    _, owner = np.unique(doc, return_inverse=True)
    index = fmindex.FMIndex(codes, lengths, len(alphabet) + 1, owner.astype(np.int32))
    begin = np.cumsum(lengths) - lengths
    row, place = X.ragged(lengths - window + 1)
    length = index.matching_statistics(codes, begin[row] + place + window, begin[row], owner[row], window)
    return length >= window


SUFFIXES = repeats.Kind(window=100, core=32, words=False, within=True, find=repeated_by_suffixes)
PASSAGES = repeats.Kind(window=13, core=5, words=True, within=False, find=repeated_by_index)


def dedup_bytes(docs: DataFrame, kind: repeats.Kind = SUFFIXES) -> DataFrame:
    """Removed runs of bytes, and the remaining bytes, of every document."""
    return repeats.repeats(docs, kind)


def dedup_words(docs: DataFrame, kind: repeats.Kind = PASSAGES) -> DataFrame:
    """Removed runs of words, and the remaining words, of every document."""
    return repeats.repeats(docs, kind)


def _removed() -> F.Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", F.col("n_symbols").alias("n_bytes"), _removed().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_words(docs).select("doc_id", F.col("n_symbols").alias("n_words"), _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i+12] AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
r AS (SELECT DISTINCT g.doc_id, unnest(generate_series(i, i + 12)) AS i FROM g JOIN m USING (win) WHERE g.doc_id > m.first),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT p.doc_id, count(r.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL), '') AS kept FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
