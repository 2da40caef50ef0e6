"""PDF: documents are written as files, read back and compared with their lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quire.plans import views as V
from quire.plans.registry import query
from quire.sources import pdf

_RUNS = V.with_views("runs")
_LINES = _RUNS + ", l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS n FROM runs WHERE text <> '')"


def _pages(text: str | None) -> list[list[tuple]]:
    """Forty lines to a page, 14 points apart."""
    lines = (text or "").split("\n")
    return [[(72, 72 + 14 * k, 10, t) for k, t in enumerate(lines[i : i + 40]) if t] for i in range(0, len(lines), 40)]


def _damaged(doc: int, data: bytes) -> bytes:
    """Nothing, the head, the last mark, blanks of the cross-reference rows, a length or an encryption mark."""
    if doc % 6 == 1:
        return b"%PDX" + data[4:]
    if doc % 6 == 2:
        return data.replace(b"startxref", b"startxxxx")
    if doc % 6 == 3:
        at = data.rindex(b"xref\n", 0, data.rindex(b"startxref"))
        return data[:at] + data[at:].replace(b" n \n", b" n\n").replace(b" f \n", b" f\n")
    if doc % 6 == 4:
        return re.sub(rb"/Length (\d+)", lambda m: b"/Length " + b"1".rjust(len(m[1]), b"0"), data)
    return data.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt<<>>") if doc % 6 == 5 else data


def _noted(doc: int, text: str | None) -> bytes:
    """With a box for every third line, and a count of those that follow them; of every second file the last note is freed again."""
    data = pdf.written(_pages(text))
    lines = (text or "").split("\n")
    notes = [(k // 40 + 1, (7200, 6200 + k % 40 * 1400, 20000, 7400 + k % 40 * 1400) if k % 3 == 0 else None, str(k)) for k in range(len(lines)) if k % 3 < 2]
    data = pdf.annotated(data, notes)
    return pdf.revised(data, {max(pdf.Pdf(data).entries): None}) if doc % 2 else data


#: Bytes of the documents' table for one task: files are long work, and a row group of them can't be split.
TASK_BYTES = 2 << 20


def _read(spark, sf_dir, made, read, schema):
    """What ``read`` makes of the documents as files (path, content), which are written one at a time as they are asked for."""

    def files(batches):
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                i = i.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([str(i)], pa.string()), pa.array([made(i, text.as_py())], pa.binary())], ["path", "content"])

    docs = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.dealt(docs, TASK_BYTES, "doc_id", "text").mapInArrow(lambda batches: read(files(batches)), schema)


@query(_LINES + " SELECT doc_id, page, n AS ord, text, 7200::BIGINT AS x, (7200 + ord % 40 * 1400)::BIGINT AS y, (length(text) * 500)::BIGINT AS advance, 1000::BIGINT AS em FROM l")
def pdf_runs(spark, sf_dir):
    found = _read(spark, sf_dir, lambda i, t: pdf.written(_pages(t)), pdf._runs, pdf.RUNS)
    return found.where("ord is not null").select(F.col("path").cast("bigint").alias("doc_id"), "page", "ord", "text", "x", "y", "advance", "em")


@query(_RUNS + """ SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 3) THEN max(page) END AS pages, CASE WHEN doc_id % 6 IN (0, 3) THEN count(*) FILTER (text <> '') END AS runs, CASE WHEN doc_id % 6 IN (0, 3) THEN doc_id % 6 = 3 END AS repaired,
CASE doc_id % 6 WHEN 1 THEN 'no-header' WHEN 2 THEN 'no-startxref' WHEN 4 THEN 'lost-stream' WHEN 5 THEN 'encrypted' END AS refusal FROM runs GROUP BY doc_id""")
def pdf_refusals(spark, sf_dir):
    """Files that are whole, repaired or refused, and how many pages the tree of each has."""
    found = _read(spark, sf_dir, lambda i, t: _damaged(i, pdf.written(_pages(t))), pdf._facts, pdf.FACTS)
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "pages", "runs", "repaired", "refusal")


@query(_LINES + " SELECT doc_id, page, n AS mcid, 'Document/P' AS path, text FROM l")
def pdf_structure(spark, sf_dir):
    """What the structure tree says of each line, joined to the runs by page and number."""
    made = lambda i, t: pdf.written(_pages(t), marked=True)
    schema = "file string, on bigint, number bigint, roles string"

    def roles(path, content):
        return ({"file": path, "on": page, "number": mcid, "roles": names} for page, mcid, names in pdf.structure(pdf.Pdf(content)))

    told = _read(spark, sf_dir, made, lambda files: pdf.each(files, roles, schema), schema)
    runs = _read(spark, sf_dir, made, pdf._runs, pdf.RUNS)
    both = runs.join(told, (F.col("path") == F.col("file")) & (F.col("page") == F.col("on")) & (F.col("mcid") == F.col("number")))
    return both.select(F.col("file").cast("bigint").alias("doc_id"), "page", "mcid", F.col("roles").alias("path"), "text")


@query(_RUNS + """, k AS (SELECT doc_id, count(*) FILTER (ord % 3 = 0) AS boxes, count(*) FILTER (ord % 3 = 1) AS others FROM runs GROUP BY doc_id),
s AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS back FROM runs WHERE ord % 3 = 0)
SELECT s.doc_id, page, 'Square' AS kind, ord::VARCHAR AS contents FROM s JOIN k USING (doc_id) WHERE NOT (doc_id % 2 = 1 AND others = 0 AND back = 1) UNION ALL SELECT doc_id, 1, 'Text', others || ' without a box' FROM k WHERE others > 0 AND doc_id % 2 = 0""")
def pdf_notes(spark, sf_dir):
    """Annotations of copies with found things drawn in; what a later revision freed doesn't come back."""
    schema = "doc_id bigint, page bigint, kind string, contents string"

    def notes(path, content):
        return ({"doc_id": int(path)} | a for a in pdf.annotations(pdf.Pdf(content)))

    return _read(spark, sf_dir, _noted, lambda files: pdf.each(files, notes, schema), schema)
