"""Matching rules over boxes, words and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import matching as M
from quire.plans import views as V
from quire.plans.registry import query

_RUNS = V.with_views("runs")
_BOXES = V.with_views("boxes") + ", b AS (SELECT * FROM boxes WHERE x1 > x0 AND y1 > y0)"


def _valid(spark, sf_dir):
    return V.boxes(spark, sf_dir).where("x1 > x0 and y1 > y0")


@query(_RUNS + r" SELECT doc_id, ord, regexp_matches(CASE WHEN ord % 5 = 0 THEN text || ' ' || chr(1513) ELSE text END, '[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') AS rtl FROM runs")
def rtl_detect(spark, sf_dir):
    return V.runs(spark, sf_dir).select("doc_id", "ord", M.is_rtl(F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit(" ש"))).otherwise(F.col("text"))).alias("rtl"))


@query(r"SELECT l_orderkey, l_linenumber, l_partkey, regexp_matches(t, '^[0-9\s.,%()+\-−–$€£¥]*$') AND regexp_matches(t, '[0-9]') AS number FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '$ ' || l_suppkey WHEN 1 THEN l_suppkey || ' apples' WHEN 2 THEN '( )' ELSE '−' || l_suppkey || '%' END AS t FROM lineitem)")
def track_numbers(spark, sf_dir):
    s, k = F.col("l_suppkey").cast("string"), F.col("l_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("$ "), s)).when(k == 1, F.concat(s, F.lit(" apples"))).when(k == 2, F.lit("( )")).otherwise(F.concat(F.lit("−"), s, F.lit("%")))
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.is_track_number(t).alias("number"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'iv' ELSE (o_orderkey % CASE WHEN o_custkey % 2 = 0 THEN 100000 ELSE 997 END)::VARCHAR END AS t FROM orders),
k AS (SELECT *, max(CASE WHEN regexp_matches(t, '^[0-9]{1,4}$') THEN t::INT END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM c)
SELECT o_custkey, bool_and(CASE WHEN regexp_matches(t, '^[0-9]{1,4}$') THEN t::INT >= coalesce(high, 0) ELSE regexp_matches(t, '^[ivxlcdmIVXLCDM]+$') END) AND count(*) >= 3 AS contents FROM k GROUP BY o_custkey""")
def contents_columns(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    page = F.col("o_orderkey") % F.when(F.col("o_custkey") % 2 == 0, 100000).otherwise(997)
    return M.is_contents(o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "iv").otherwise(page.cast("string")).alias("text")), "o_custkey", order="o_orderkey")


@query(_RUNS + """, m AS (SELECT doc_id, ord, x0 AS x, y0 AS y, CASE WHEN ord % 6 > 0 THEN x1 - x0 END AS adv, CASE WHEN ord % 4 > 0 THEN 800 END AS a, CASE WHEN ord % 9 = 0 THEN 900 ELSE -200 END AS d FROM runs),
w AS (SELECT *, CASE WHEN a IS NULL THEN 'no-metrics' WHEN adv IS NULL OR adv = 0 THEN 'no-ink-to-measure' WHEN a <= d THEN 'invalid' END AS absence FROM m)
SELECT doc_id, ord, CASE WHEN absence IS NULL THEN x END AS x0, CASE WHEN absence IS NULL THEN y - a END AS y0, CASE WHEN absence IS NULL THEN x + adv END AS x1, CASE WHEN absence IS NULL THEN y - d END AS y1, absence FROM w""")
def ink_boxes(spark, sf_dir):
    r = V.runs(spark, sf_dir)
    box = M.ink_box(F.col("x0"), F.col("y0"), F.when(F.col("ord") % 6 > 0, F.col("x1") - F.col("x0")), F.when(F.col("ord") % 4 > 0, F.lit(800)), F.when(F.col("ord") % 9 == 0, 900).otherwise(-200))
    return r.select("doc_id", "ord", box.alias("b")).select("doc_id", "ord", "b.*")


@query(_RUNS + " SELECT doc_id, ord, array_to_string(list_filter([CASE WHEN x1 <= 0 OR x0 >= 61200 OR y1 <= 0 OR y0 >= 45000 THEN 'off-page-text' END, CASE WHEN ord % 4 = 3 THEN 'invisible-render-mode-text' END], lambda x: x IS NOT NULL), ',') AS findings FROM runs")
def off_page_text(spark, sf_dir):
    return M.findings(V.runs(spark, sf_dir).withColumn("mode", F.col("ord") % 4), 61200, 45000).select("doc_id", "ord", F.array_join("findings", ",").alias("findings"))


_IN = "r.x0 >= b.x0 AND r.x0 <= b.x1 AND r.y0 >= b.y0 AND r.y0 <= b.y1"


@query(_BOXES + f" SELECT b.page, b.id, coalesce(sum(CASE WHEN {_IN} THEN 5 + r.id % 9 END), 0)::BIGINT AS chars FROM b JOIN b r ON r.page = b.page GROUP BY ALL")
def text_inside(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.text_inside(b, b.withColumn("text", F.concat(F.repeat(F.lit("x"), (5 + F.col("id") % 9).cast("int")), F.lit(" "))))


@query(_BOXES + f", c AS (SELECT b.page, b.id, any_value((b.x1 - b.x0) * (b.y1 - b.y0)) AS size, coalesce(sum(CASE WHEN {_IN} THEN 40 END), 0)::BIGINT AS chars FROM b JOIN b r ON r.page = b.page GROUP BY ALL) SELECT page, id, size * 10 < 100000000 * 8 AND chars < 120 AS kept FROM c")
def panel_exclusion(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.panels(b, b.withColumn("text", F.lit("x" * 40)), 100000000).select("page", "id", "kept")


@query(_BOXES + """, p AS (SELECT b.page, b.id AS bar, l.id AS label FROM b JOIN b l ON l.page = b.page AND l.id <> b.id WHERE (l.x0 + l.x1) // 2 >= b.x0 AND (l.x0 + l.x1) // 2 < b.x1 AND (l.y0 + l.y1) // 2 >= b.y0 AND (l.y0 + l.y1) // 2 < b.y1),
n AS (SELECT *, count(*) OVER (PARTITION BY page, bar) AS n, count(*) OVER (PARTITION BY page, label) AS m FROM p) SELECT page, bar, label FROM n WHERE n = 1 AND m = 1""")
def bar_values(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.only_match(b, b, "page")


@query(_BOXES + """, p AS (SELECT b.page, b.id AS bar, l.id AS label, l.y0 - b.y1 AS distance FROM b JOIN b l ON l.page = b.page AND l.id <> b.id AND (l.x0 + l.x1) // 2 >= b.x0 AND (l.x0 + l.x1) // 2 < b.x1 AND l.y0 >= b.y1)
SELECT page, bar, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY page, bar ORDER BY distance, label) AS r FROM p) WHERE r = 1""")
def labels_below(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.nearest_below(b, b, "page")


_TRACK = _BOXES + """, t AS (SELECT page, id AS k, x0 AS t0, x1 AS t1 FROM b WHERE id % 4 = 0),
d AS (SELECT b.page, id, k, abs((x0 + x1) // 2 - (t0 + t1) // 2) AS dc, abs(x0 - t0) AS dl, abs(x1 - t1) AS dr FROM b JOIN t USING (page)),
w AS (SELECT page, id, min(CASE WHEN dc <= 600 THEN (0, dc, k) WHEN dl <= 600 THEN (1, dl, k) WHEN dr <= 600 THEN (2, dr, k) END) AS best FROM d GROUP BY ALL), placed AS (SELECT page, id, best[3] AS track FROM w)"""


@query(_TRACK + " SELECT page, id, track FROM placed")
def track_of(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.track_of(b, b.where("id % 4 = 0"), "page")


@query(_TRACK + " SELECT page, count(*) FILTER (track IS NULL) <= 1 AND count(DISTINCT track) = count(track) AS fits FROM placed GROUP BY page")
def row_fits(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return M.row_fits(M.track_of(b, b.where("id % 4 = 0"), "page"), "page")


@query(V.with_views("words") + " SELECT doc_id, ord, w, coalesce(lag(x1) OVER v < x0, true) AND coalesce(lead(x0) OVER v > x1, true) AS clear FROM words WINDOW v AS (PARTITION BY doc_id, ord ORDER BY x0, w)")
def clear_of_neighbours(spark, sf_dir):
    return M.clear_of_neighbours(V.words(spark, sf_dir), "doc_id", "ord", order="w").select("doc_id", "ord", "w", "clear")


@query(_RUNS + " SELECT doc_id, ord FROM runs WHERE NOT (doc_id % 2 = 0 AND ord % 40 BETWEEN 5 AND 9)")
def unclaimed_runs(spark, sf_dir):
    r = V.runs(spark, sf_dir).select("doc_id", "ord")
    return M.unclaimed(r, r.where("doc_id % 2 = 0 and ord % 40 between 5 and 9"), "doc_id", "ord")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not_checked' WHEN doc_id % 3 = 1 THEN 'matched' ELSE 'mismatched' END AS binding FROM documents")
def source_binding(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    declared = d.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(F.lit("0")).alias("digest"))
    return M.source_binding(d, declared, "doc_id")


@query(_RUNS + " SELECT doc_id, count(*) FILTER (octet_length(encode(text)) <= 300) AS kept, count(*) FILTER (octet_length(encode(text)) > 300) AS omitted FROM runs GROUP BY doc_id")
def elements_omitted(spark, sf_dir):
    return M.elements_omitted(V.runs(spark, sf_dir), 300, "doc_id")


@query(_RUNS + """, u AS (SELECT doc_id, ord, ord // 3 AS unit, CASE WHEN em > 1500 THEN 1 WHEN em > 1100 THEN 2 END AS level, bold FROM runs)
SELECT doc_id, ord, coalesce(lag(unit) OVER w = unit AND (coalesce(lag(level) OVER w = level, false) OR (lag(level) OVER w IS NULL AND level IS NULL AND lag(bold) OVER w AND bold)), false) AS continues FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def unit_continuation(spark, sf_dir):
    r = V.runs(spark, sf_dir).withColumn("unit", F.expr("ord div 3")).withColumn("level", F.expr("CASE WHEN em > 1500 THEN 1 WHEN em > 1100 THEN 2 END"))
    return M.unit_continues(r, "doc_id", order="ord").select("doc_id", "ord", "continues")
