"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A blob is
scanned once for each version of the rules; what the ledger holds already is
not read again. Findings are then joined back to every path of the blob.

Nulls count as empty texts, which are a blob like any other and have no
finding. Rows that repeat, or share an id, each come back. An empty table gives
an empty result. Columns other than the path and the text are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import store

#: Name, pattern, group that is measured, least characters of it. In the order in which kinds are listed.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RULE_VERSION = 1

LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.IntegerType()), T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def scan_text(text: str | None, rules=RULES) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive) of what the rules find, by start, then kind as listed."""
    if not text:
        return []
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        if kind == "assign" and ":" not in text and "=" not in text or kind == "access" and "AKIA" not in text:
            continue
        if kind == "hex":  # runs are maximal, so short ones can be left out by the pattern itself
            pattern = rf"[0-9a-f]{{{least},}}"
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def _scan(batches, rules, version):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        blobs, found = [], []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text"), strict=True):
            blobs.append(blob)
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in scan_text(text.as_py(), rules)])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array([version] * len(blobs), pa.int32()), pa.array(found, pa.list_(kind))], ["blob", "rule_version", "findings"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty where nothing was written yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, path: str, text: str, ledger: str, rules=RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings of every version of a text: (path, blob, findings).

    versions: a row for each version of each path, historical ones included.
    Blobs whose pair with rule_version is in the ledger are not scanned; the
    others are, once each, and appended to it. One text moves for each unseen
    blob: copies collapse before the shuffle.
    """
    spark = versions.sparkSession
    own = versions.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    blobs = own.select("blob", "text").groupBy("blob").agg(F.first("text").alias("text"))
    if seen.limit(1).count():
        blobs = blobs.join(seen, "blob", "left_anti")
    blobs.mapInArrow(lambda b: _scan(b, rules, rule_version), LEDGER).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    paths = own.select("path", "blob")
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(LEDGER["findings"].dataType)).alias("findings"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_versions(docs, "doc_id", "text", store.new_path(spark, "secret-ledger"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("findings", lambda s: s["kind"].isin("assign", "access", "hex"))), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


#: Marks each match with private-use characters and splits there, so that lengths give the places.
OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT rid, 0 AS k, 'assign' AS kind, string_split(regexp_replace(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])(["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', chr(57344) || '\1\2' || chr(57345) || '\3' || chr(57346), 'g'), chr(57344)) AS parts, 6 AS least FROM docs
  UNION ALL
  SELECT rid, 1, 'access', string_split(regexp_replace(text, '(AKIA[A-Z0-9]+)', chr(57344) || chr(57345) || '\1' || chr(57346), 'g'), chr(57344)), 20 FROM docs
  UNION ALL
  SELECT rid, 2, 'hex', string_split(regexp_replace(text, '([0-9a-f]+)', chr(57344) || chr(57345) || '\1' || chr(57346), 'g'), chr(57344)), 24 FROM docs),
piece AS (SELECT rid, k, kind, least, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM found),
sized AS (SELECT rid, k, kind, least, i, p, length(p) - CASE WHEN i > 1 THEN 2 ELSE 0 END AS len,
  CASE WHEN i > 1 THEN instr(p, chr(57345)) - 1 END AS head, CASE WHEN i > 1 THEN instr(p, chr(57346)) - instr(p, chr(57345)) - 1 END AS val FROM piece),
placed AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY rid, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
spans AS (SELECT rid, k, kind, start, start + head + val AS stop FROM placed WHERE i > 1 AND val >= least),
said AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans,
  count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN said USING (rid)
"""
