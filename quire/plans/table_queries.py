"""Table rules over order lines as cells, and boxes of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import tables as T
from quire.plans import views as V
from quire.plans.registry import query

_GRID = "grids AS (SELECT tbl, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols FROM cells GROUP BY tbl)"
_CELLS = V.with_views("cells") + ", " + _GRID
_SLOTS = ", slots AS (SELECT *, unnest(generate_series(c, c + colspan - 1)) AS sc FROM (SELECT *, unnest(generate_series(r, r + rowspan - 1)) AS sr FROM cells))"


def _grids(cells):
    return cells.groupBy("tbl").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))


@query(_CELLS + _SLOTS + " SELECT tbl, sr, sc, count(*) AS owners FROM slots GROUP BY ALL")
def table_slots(spark, sf_dir):
    return T.cover(V.cells(spark, sf_dir))


_FAULTS = _CELLS + _SLOTS + """, cov AS (SELECT tbl, sr, sc, count(*) AS owners FROM slots GROUP BY ALL),
grid AS (SELECT tbl, sr, unnest(generate_series(0, n_cols - 1)) AS sc FROM (SELECT *, unnest(generate_series(0, n_rows - 1)) AS sr FROM grids)),
flt AS (SELECT coalesce(c.tbl, g.tbl) AS tbl, coalesce(c.sr, g.sr) AS sr, coalesce(c.sc, g.sc) AS sc, CASE WHEN g.tbl IS NULL THEN 'outside-grid' WHEN owners IS NULL THEN 'unowned' WHEN owners > 1 THEN 'owned-more-than-once' END AS fault
  FROM cov c FULL JOIN grid g ON c.tbl = g.tbl AND c.sr = g.sr AND c.sc = g.sc)"""


@query(_FAULTS + " SELECT tbl, sr, sc, fault FROM flt WHERE fault IS NOT NULL")
def slot_faults(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return T.faults(c, _grids(c))


_PLAN = _CELLS + ", planned AS (SELECT cells.*, n_rows, n_cols, r < n_rows AND c < n_cols AND row_number() OVER (PARTITION BY tbl, r, c ORDER BY cell) = 1 AS placed FROM cells JOIN grids USING (tbl))"


@query(_PLAN + " SELECT tbl, count(*) FILTER (NOT placed) AS not_placed, sum(CASE WHEN placed THEN rowspan * colspan - 1 ELSE 0 END)::BIGINT AS span_slots FROM planned GROUP BY tbl")
def table_plan(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return T.erasures(T.plan(c, _grids(c)))


# Spans here are two at most, so a span shrinks to one as soon as an origin lies in what it adds.
_CLAMP = _PLAN + """, p AS (SELECT * FROM planned WHERE placed), o AS (SELECT tbl, r AS orow, c AS ocol FROM p),
reach AS (SELECT *, least(rowspan, n_rows - r) AS fr, least(colspan, n_cols - c) AS fc FROM p),
cl1 AS (SELECT *, CASE WHEN fc = 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.tbl = reach.tbl AND o.ocol = c + 1 AND o.orow BETWEEN r AND r + fr - 1) THEN 2 ELSE 1 END::BIGINT AS fit_cols FROM reach),
clamped AS (SELECT *, CASE WHEN fr = 2 AND NOT EXISTS (SELECT 1 FROM o WHERE o.tbl = cl1.tbl AND o.orow = r + 1 AND o.ocol BETWEEN c AND c + fit_cols - 1) THEN 2 ELSE 1 END::BIGINT AS fit_rows FROM cl1)"""


def _clamped(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return T.clamp(T.plan(c, _grids(c)))


@query(_CLAMP + " SELECT tbl, cell, fit_rows, fit_cols FROM clamped")
def span_clamp(spark, sf_dir):
    return _clamped(spark, sf_dir).select("tbl", "cell", "fit_rows", "fit_cols")


@query(_CLAMP + """ SELECT tbl, r, '<tr>' || string_agg('<td' || CASE WHEN fit_rows > 1 THEN ' rowspan="' || fit_rows || '"' ELSE '' END || CASE WHEN fit_cols > 1 THEN ' colspan="' || fit_cols || '"' ELSE '' END || '>' || text || '</td>', '' ORDER BY c) || '</tr>' AS html FROM clamped GROUP BY tbl, r""")
def table_html_rows(spark, sf_dir):
    return T.html_rows(_clamped(spark, sf_dir))


@query(_CLAMP + """, par AS (SELECT tbl, c AS start, fit_cols AS span FROM clamped WHERE r = 0 AND fit_cols > 1),
kids AS (SELECT p.tbl, p.start, count(k.c) AS n, coalesce(bool_and(k.fit_rows = 1 AND k.c + k.fit_cols <= p.start + p.span), false) AS fine FROM par p LEFT JOIN clamped k ON k.tbl = p.tbl AND k.r = 1 AND k.c >= p.start AND k.c < p.start + p.span GROUP BY ALL),
dv AS (SELECT tbl, bool_and(n >= 2 AND fine) AS every FROM kids GROUP BY tbl)
SELECT g.tbl, CASE WHEN n_rows > 2 AND every THEN 2 ELSE 0 END::INT AS header FROM (SELECT tbl, max(n_rows) AS n_rows FROM clamped GROUP BY tbl) g LEFT JOIN dv USING (tbl)""")
def header_rows(spark, sf_dir):
    return T.header_rows(_clamped(spark, sf_dir))


def _placed_cells(spark, sf_dir):
    """All runs of every page, in three columns and rows 800 apart, the fifth sometimes out of order."""
    r = V.runs(spark, sf_dir)
    k = F.col("ord") % 40
    jitter = F.length("text") % 3 * 40
    return r.select("doc_id", "page", "ord", (7200 + (k % 3) * 9000 + jitter).cast("bigint").alias("x0"), (7200 + F.floor(k / 3) * F.when(F.col("doc_id") % 5 == 0, 400).otherwise(800) + F.when((F.col("doc_id") % 7 == 0) & (k == 4), -800).otherwise(0)).cast("bigint").alias("y0"))


_UNRULED = V.with_views("runs") + """, q AS (SELECT doc_id, page, ord, 7200 + (ord % 40 % 3) * 9000 + length(text) % 3 * 40 AS x0, 7200 + (ord % 40 // 3) * CASE WHEN doc_id % 5 = 0 THEN 400 ELSE 800 END + CASE WHEN doc_id % 7 = 0 AND ord % 40 = 4 THEN -800 ELSE 0 END AS y0 FROM runs),
f AS (SELECT doc_id, page, list_reduce(list_transform(list_sort(list_distinct(list(x0))), lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[len(a)] > 150 THEN list_append(a, v[1]) ELSE a END) AS xs,
  list_reduce(list_transform(list_sort(list_distinct(list(y0))), lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[len(a)] > 150 THEN list_append(a, v[1]) ELSE a END) AS ys FROM q GROUP BY ALL),
fc AS (SELECT doc_id, page, ord, xs, ys, (greatest(len(list_filter(ys, lambda v: v <= y0)), 1) - 1) * len(xs) + greatest(len(list_filter(xs, lambda v: v <= x0)), 1) - 1 AS face FROM q JOIN f USING (doc_id, page)),
hi AS (SELECT *, face < max(face) OVER (PARTITION BY doc_id, page ORDER BY ord) AS falls FROM fc),
gp AS (SELECT doc_id, page, min(xg) AS xg FROM (SELECT doc_id, page, x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS xg FROM (SELECT doc_id, page, unnest(xs) AS x FROM f)) GROUP BY ALL),
gq AS (SELECT doc_id, page, min(yg) AS yg FROM (SELECT doc_id, page, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS yg FROM (SELECT doc_id, page, unnest(ys) AS y FROM f)) GROUP BY ALL),
st AS (SELECT doc_id, page, count(DISTINCT face) AS filled, bool_or(falls) AS falls FROM hi GROUP BY ALL)"""


@query(_UNRULED + """ SELECT doc_id, page, len(ys)::BIGINT AS n_rows, len(xs)::BIGINT AS n_cols, CASE WHEN len(ys) < 2 OR len(xs) < 2 THEN 'none' WHEN len(xs) * len(ys) > 4096 THEN 'too-many-faces' WHEN xg < 1200 THEN 'column-gutter' WHEN yg < 600 THEN 'row-gutter' WHEN filled < len(xs) * len(ys) THEN 'empty-face' WHEN falls THEN 'emission-order' END AS refusal
FROM f JOIN gp USING (doc_id, page) JOIN gq USING (doc_id, page) JOIN st USING (doc_id, page)""")
def unruled_lattice(spark, sf_dir):
    return T.unruled(_placed_cells(spark, sf_dir), "doc_id", "page")


@query(_UNRULED + " SELECT doc_id, page, min(ord) AS at FROM hi WHERE falls GROUP BY ALL")
def order_faults(spark, sf_dir):
    runs = _placed_cells(spark, sf_dir)
    per = runs.groupBy("doc_id", "page").agg(L.fold(F.collect_set("x0")).alias("xs"), L.fold(F.collect_set("y0")).alias("ys"))
    line = lambda lines, v: F.greatest(F.size(F.filter(lines, lambda x: x <= F.col(v))) - 1, F.lit(0))
    from pyspark.sql import Window as W

    faced = runs.join(per, ["doc_id", "page"]).withColumn("face", line("ys", "y0") * F.size("xs") + line("xs", "x0"))
    high = F.max("face").over(W.partitionBy("doc_id", "page").orderBy("ord"))
    return faced.withColumn("falls", F.col("face") < high).where("falls").groupBy("doc_id", "page").agg(F.min("ord").alias("at"))


@query(_UNRULED + " SELECT doc_id, page, coalesce(xg < 1200, false) AS columns, coalesce(yg < 600, false) AS lines FROM gp JOIN gq USING (doc_id, page)")
def gutter_faults(spark, sf_dir):
    per = _placed_cells(spark, sf_dir).groupBy("doc_id", "page").agg(L.fold(F.collect_set("x0")).alias("xs"), L.fold(F.collect_set("y0")).alias("ys"))
    near = lambda c, floor: F.coalesce(F.exists(F.zip_with(F.slice(c, F.lit(2), F.size(c)), c, lambda b, a: b - a), lambda g: g < floor), F.lit(False))
    return per.select("doc_id", "page", near("xs", 1200).alias("columns"), near("ys", 600).alias("lines"))


_VALID = V.with_views("boxes") + ", b AS (SELECT * FROM boxes WHERE x1 > x0 AND y1 > y0), t AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) - 500 AS x1, max(y1) AS y1 FROM b GROUP BY page)"


def _valid(spark, sf_dir):
    return V.boxes(spark, sf_dir).where("x1 > x0 and y1 > y0")


@query(_VALID + """ SELECT page, count(*) FILTER (NOT (b.x0 >= t.x0 AND b.y0 >= t.y0 AND b.x1 <= t.x1 AND b.y1 <= t.y1)) AS outside, coalesce(any_value(n), 0) AS overlaps, sum((b.x1 - b.x0) * (b.y1 - b.y0)) = any_value((t.x1 - t.x0) * (t.y1 - t.y0)) AS tiles
FROM b JOIN t USING (page) LEFT JOIN (SELECT p.page, count(*) AS n FROM b p JOIN b q ON p.page = q.page AND p.id < q.id AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 GROUP BY p.page) o USING (page) GROUP BY page""")
def cross_check(spark, sf_dir):
    b = _valid(spark, sf_dir)
    t = b.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max("x1") - 500).alias("x1"), F.max("y1").alias("y1"))
    return T.cross_check(b, t)


@query(_CELLS + """, g AS (SELECT * REPLACE (CASE WHEN qty % 3 = 0 THEN text || ' x' ELSE text END AS text) FROM (SELECT *, text::BIGINT AS qty FROM cells)),
ds AS (SELECT DISTINCT tbl, sr, sc, text AS t FROM (SELECT *, unnest(generate_series(c, c + colspan - 1)) AS sc FROM (SELECT *, unnest(generate_series(r, r + rowspan - 1)) AS sr FROM cells))),
gs AS (SELECT DISTINCT tbl, sr, sc, text AS t FROM (SELECT *, unnest(generate_series(c, c + colspan - 1)) AS sc FROM (SELECT *, unnest(generate_series(r, r + rowspan - 1)) AS sr FROM g))),
j AS (SELECT coalesce(d.tbl, x.tbl) AS tbl, d.tbl IS NOT NULL AS d, x.tbl IS NOT NULL AS x FROM ds d FULL JOIN gs x ON d.tbl = x.tbl AND d.sr = x.sr AND d.sc = x.sc AND d.t = x.t),
n AS (SELECT tbl, count(*) FILTER (d AND x) AS tp, count(*) FILTER (NOT x) AS fp, count(*) FILTER (NOT d) AS fn FROM j GROUP BY tbl)
SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2000 * tp // (2 * tp + fp + fn) END AS f1 FROM n""")
def cell_f1(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return T.cell_f1(c, c.withColumn("text", F.when(F.col("text").cast("bigint") % 3 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))))


@query(_VALID + ", r AS (SELECT * FROM b WHERE id % 5 = 0) SELECT b.page, r.id AS region, count(*) AS n, array_to_string(list_sort(list(b.id)), ',') AS ids FROM b JOIN r ON b.page = r.page AND b.x0 >= r.x0 AND b.x0 < r.x1 AND b.y0 >= r.y0 AND b.y0 < r.y1 GROUP BY ALL")
def runs_inside(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return T.runs_inside(b, b.where("id % 5 = 0"))


@query(_VALID + ", r AS (SELECT * FROM b WHERE id % 5 = 0) SELECT b.page, b.id, min(r.id) FILTER (b.x0 >= r.x0 AND b.x0 < r.x1 AND b.y0 >= r.y0 AND b.y0 < r.y1) AS region FROM b JOIN r ON b.page = r.page GROUP BY ALL")
def run_in_box(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return T.first_region(b, b.where("id % 5 = 0"))


@query(_VALID + " SELECT b.page, b.id FROM b WHERE id % 2 = 0 AND EXISTS (SELECT 1 FROM b t WHERE t.page = b.page AND t.id % 2 = 1 AND 2 * greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) >= (b.x1 - b.x0) * (b.y1 - b.y0))")
def figure_overlap(spark, sf_dir):
    b = _valid(spark, sf_dir)
    return T.overlapped_by_half(b.where("id % 2 = 0"), b.where("id % 2 = 1")).select("page", "id")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_quantity)::BIGINT % 5 + 1 AS repeat FROM lineitem GROUP BY ALL),
s AS (SELECT *, coalesce(sum(repeat) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c)
SELECT l_orderkey, l_linenumber, part, start + unnest(generate_series(0, repeat - 1)) AS col FROM s""")
def ods_repeat_expand(spark, sf_dir):
    c = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), (F.min("l_quantity").cast("bigint") % 5 + 1).alias("repeat"))
    return T.expand_repeats(c, "l_orderkey", order="l_linenumber").select("l_orderkey", "l_linenumber", "part", "col")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::BIGINT AS length, max(l_extendedprice / l_quantity)::BIGINT AS value FROM lineitem GROUP BY ALL)
SELECT p.l_orderkey, count(DISTINCT p.l_linenumber) >= 2 AND count(*) FILTER (10 * p.length < 9 * q.length AND p.value > q.value OR 4 * p.length < 3 * q.length AND p.value >= q.value) = 0 AS agrees FROM b p JOIN b q USING (l_orderkey) WHERE p.length > 0 AND p.value > 0 AND q.length > 0 AND q.value > 0 GROUP BY p.l_orderkey""")
def bars_in_order(spark, sf_dir):
    b = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("bigint").alias("length"), F.round(F.max(F.col("l_extendedprice") / F.col("l_quantity"))).cast("bigint").alias("value"))
    return T.in_order(b, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey + 1")
def xlsx_shared_strings(spark, sf_dir):
    """Cells that hold an index into the table of shared strings; an index beyond it has no text."""
    c = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    strings = V.table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("l_partkey"), F.col("p_name").alias("text"))
    return c.join(strings, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "text")
