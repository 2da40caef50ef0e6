"""Layout rules over the runs of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import strings as S
from quire.operators import layout as L
from quire.plans import views as V
from quire.plans.registry import query

_RUNS = V.with_views("runs")
#: Baselines of a page of runs: at least 1200 apart, so every distinct one is a line.
_LINES = _RUNS + ", lns AS (SELECT doc_id, page, y0 AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS line FROM (SELECT DISTINCT doc_id, page, y0 FROM runs))"
_LEAD = _LINES + """, gaps AS (SELECT doc_id, page, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM lns),
bins AS (SELECT doc_id, page, (gap + 5) // 10 * 10 AS bin, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY ALL),
leads AS (SELECT doc_id, page, max(n) AS best, sum(n) AS total, arg_max(bin, (n, -bin)) AS ld FROM bins GROUP BY ALL),
leadings AS (SELECT doc_id, page, ld FROM leads WHERE ld >= 600 AND 4 * best >= total)"""
_SLABS = _LEAD + """, slab AS (SELECT doc_id, page, line, y, sum(cut) OVER (PARTITION BY doc_id, page ORDER BY line)::BIGINT AS slab FROM (
  SELECT l.*, coalesce((5 * (y - lag(y) OVER (PARTITION BY l.doc_id, l.page ORDER BY line)) >= 8 * ld)::INT, 0) AS cut FROM lns l LEFT JOIN leadings g USING (doc_id, page)))"""


@query(
    "WITH f AS (SELECT vec_id, list_sort(list_transform(embedding, lambda v: floor(v::DOUBLE * 2000)::BIGINT)) AS vs FROM embeddings) "
    "SELECT vec_id, len(a)::BIGINT AS n_lines, list_sum(a)::BIGINT AS anchor_sum FROM (SELECT vec_id, list_reduce(list_distinct_sorted, lambda acc, v: CASE WHEN v[1] - acc[len(acc)] > 150 THEN list_append(acc, v[1]) ELSE acc END) AS a FROM "
    "(SELECT vec_id, list_transform(list_sort(list_distinct(vs)), lambda v: [v]) AS list_distinct_sorted FROM f))"
)
def line_fold(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", L.fold(F.transform("embedding", lambda v: F.floor(v.cast("double") * 2000))).alias("a"))
    return e.select("vec_id", F.size("a").cast("bigint").alias("n_lines"), F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("anchor_sum"))


@query(_LEAD + ' SELECT doc_id, page, ld AS "leading" FROM leadings')
def modal_leading(spark, sf_dir):
    return L.leading(L.lines(V.runs(spark, sf_dir), "doc_id", "page"), "doc_id", "page")


@query(_SLABS + " SELECT doc_id, page, line, y, slab FROM slab")
def slabs(spark, sf_dir):
    line = L.lines(V.runs(spark, sf_dir), "doc_id", "page")
    return L.slabs(line, L.leading(line, "doc_id", "page"), "doc_id", "page").withColumn("line", F.col("line").cast("bigint"))


@query(_SLABS + """, firsts AS (SELECT r.doc_id, r.page, r.ord, s.slab, min(r.ord) OVER (PARTITION BY r.doc_id, r.page, s.slab) AS first FROM runs r JOIN slab s ON s.doc_id = r.doc_id AND s.page = r.page AND s.y = r.y0),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY first) AS b FROM firsts)
SELECT doc_id, ord, slab, CASE WHEN max(b) OVER (PARTITION BY doc_id, page) > 1 THEN b END AS block FROM ranked""")
def block_numbering(spark, sf_dir):
    return L.blocks(V.runs(spark, sf_dir), "doc_id", "page").select("doc_id", "ord", "slab", F.col("block").cast("bigint").alias("block"))


_BANDS = V.with_views("words") + """, banded AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, ord ORDER BY x0, x1, w)::BIGINT AS band FROM (SELECT *, coalesce((x0 - max(x1) OVER (PARTITION BY doc_id, ord ORDER BY x0, x1, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 1200)::INT, 0) AS opens FROM words))"""


@query(_BANDS + " SELECT doc_id, ord, w, band FROM banded")
def column_bands(spark, sf_dir):
    return L.column_bands(V.words(spark, sf_dir), "doc_id", "ord", tie="w").select("doc_id", "ord", "w", "band")


_BOX_BANDS = V.with_views("boxes") + """, banded AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY x0, x1, id)::BIGINT AS band FROM (SELECT *, coalesce((x0 - max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 1200)::INT, 0) AS opens FROM boxes WHERE x1 > x0 AND y1 > y0))"""


@query(_BOX_BANDS + """, span AS (SELECT page, band, min(y0) AS top, max(y1) AS bottom FROM banded GROUP BY ALL),
pair AS (SELECT *, lag(top) OVER w AS pt, lag(bottom) OVER w AS pb FROM span WINDOW w AS (PARTITION BY page ORDER BY band))
SELECT page, count(*) AS bands, bool_and(pt IS NULL OR (least(bottom, pb) > greatest(top, pt) AND 2 * (least(bottom, pb) - greatest(top, pt)) >= least(bottom - top, pb - pt))) AND count(*) > 1 AS columns FROM pair GROUP BY page""")
def side_by_side(spark, sf_dir):
    b = V.boxes(spark, sf_dir).where("x1 > x0 and y1 > y0")
    return L.side_by_side(L.column_bands(b, "page", tie="id"), "page")


@query(V.with_views("boxes") + """, g AS (SELECT *, y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM boxes),
m AS (SELECT *, max(gap) OVER (PARTITION BY page) AS widest FROM g)
SELECT page, id, sum(coalesce((widest >= 600 AND gap >= widest)::INT, 0)) OVER (PARTITION BY page ORDER BY y0, y1, id)::BIGINT AS part FROM m""")
def horizontal_cut(spark, sf_dir):
    return L.horizontal_cut(V.boxes(spark, sf_dir), "page", tie="id").select("page", "id", "part")


@query(_RUNS + """, per AS (SELECT doc_id, em, sum(length(text)) AS n FROM runs GROUP BY ALL), seen AS (SELECT *, 2 * sum(n) OVER (PARTITION BY doc_id ORDER BY em) > sum(n) OVER (PARTITION BY doc_id) AS over FROM per)
SELECT doc_id, min(em) AS median FROM seen WHERE over GROUP BY doc_id""")
def body_line_median(spark, sf_dir):
    return L.weighted_median(V.runs(spark, sf_dir).withColumn("n", F.length("text")), "em", "n", "doc_id")


@query(_RUNS + """, o AS (SELECT *, coalesce((2 * (y0 - max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) >= 1000)::INT, 0) AS opens, ord % 9 > 0 AS is_text FROM runs),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS band FROM o),
f AS (SELECT *, bool_and(is_text) OVER p AS text_only, min(y0) OVER p AS top, max(y1) OVER p AS bottom, max(band) OVER (PARTITION BY doc_id, page) AS last FROM b WINDOW p AS (PARTITION BY doc_id, page, band))
SELECT doc_id, ord, CASE WHEN last > 0 AND text_only AND band = last AND 10 * (61000 - top) <= 61000 THEN 'footer' WHEN last > 0 AND text_only AND band = 0 AND 10 * bottom <= 85000 THEN CASE WHEN 10 * bottom <= 61000 THEN 'header' END END AS furniture FROM f""")
def furniture_bands(spark, sf_dir):
    pieces = V.runs(spark, sf_dir).withColumn("is_text", F.col("ord") % 9 > 0).withColumn("body", F.lit(1000))
    return L.furniture(pieces, 61000, "doc_id", "page").select("doc_id", "ord", "furniture")


_EMS = _RUNS + ", hist AS (SELECT doc_id, (em + 5) // 10 * 10 AS em, sum(length(text))::BIGINT AS chars, sum(CASE WHEN bold THEN length(text) ELSE 0 END)::BIGINT AS bold_chars FROM runs WHERE length(trim(text)) > 0 GROUP BY ALL)"


@query(_EMS + " SELECT doc_id, em, chars, bold_chars FROM hist")
def em_histogram(spark, sf_dir):
    return L.em_histogram(V.runs(spark, sf_dir), "doc_id")


_BODY = _EMS + """, lh AS (SELECT doc_id, (em + 5) // 10 * 10 AS em, count(*) AS n_lines FROM runs WHERE length(trim(text)) > 0 GROUP BY ALL),
cm AS (SELECT h.*, 20 * chars >= sum(chars) OVER (PARTITION BY doc_id) AND coalesce(n_lines, 0) >= 10 AS common FROM hist h LEFT JOIN lh USING (doc_id, em)),
body AS (SELECT doc_id, greatest(arg_max(em, (chars, -em)), coalesce(max(em) FILTER (common), 0)) AS body_em FROM cm GROUP BY doc_id)"""


@query(_BODY + " SELECT doc_id, body_em, 2 * bold_chars > chars AS body_is_bold FROM body JOIN hist USING (doc_id) WHERE em = body_em")
def body_em(spark, sf_dir):
    return L.body_em(V.runs(spark, sf_dir), "doc_id", "ord")


@query(_BODY + r""", d AS (SELECT *, (ord % 14 = 8)::INT * 2 + (ord % 14 = 9)::INT * 3 AS k FROM runs),
h AS (SELECT d.doc_id, ord, CASE WHEN k > 0 THEN k ELSE 1 END AS depth, em, 5 * em >= 6 * body_em AND length(trim(text)) > 0 AS head FROM d JOIN body USING (doc_id))
SELECT doc_id, ord, CASE WHEN head THEN least(dense_rank() OVER (PARTITION BY doc_id, head ORDER BY (em + 5) // 10 * 10 DESC, depth), 6) END::INT AS level FROM h""")
def heading_levels(spark, sf_dir):
    r = V.runs(spark, sf_dir)
    numbered = F.when(F.col("ord") % 14 == 8, F.concat(F.lit("2.1 "), "text")).when(F.col("ord") % 14 == 9, F.concat(F.lit("3.1.4. "), "text")).otherwise(F.concat(F.lit("x "), "text"))
    lines = r.withColumn("depth", F.coalesce(S.section_number(numbered), F.lit(1)))
    return L.heading_levels(lines, L.body_em(r, "doc_id", "ord"), "doc_id").select("doc_id", "ord", "level")


@query(_RUNS + r""", k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g'))) AS key FROM runs) SELECT doc_id, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) >= 3""")
def recurring_labels(spark, sf_dir):
    return L.recurring(V.runs(spark, sf_dir), "doc_id")


@query(_RUNS + " SELECT doc_id, ord, coalesce(lag(x1) OVER (PARTITION BY doc_id, page ORDER BY ord) < max(x1) OVER (PARTITION BY doc_id, page) - 10 * (y1 - y0), false) AS cut FROM runs")
def short_piece_cuts(spark, sf_dir):
    return L.short_cuts(V.runs(spark, sf_dir), "doc_id", "page").select("doc_id", "ord", "cut")


@query(_RUNS + """, p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM runs WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
g AS (SELECT doc_id, page, 20 * (y0 - py1) // (y1 - y0) AS g FROM p WHERE px0 IS NOT NULL AND 2 * (least(x1, px1) - greatest(x0, px0)) >= least(x1 - x0, px1 - px0) AND 2 * (y0 - py1) >= -(y1 - y0) AND y0 - py1 <= 3 * (y1 - y0))
SELECT doc_id, page, list_sort(list(g))[(count(*) - 1) // 2 + 1] AS lead FROM g GROUP BY ALL HAVING count(*) >= 3""")
def page_lead(spark, sf_dir):
    return L.page_lead(V.runs(spark, sf_dir), "doc_id", "page")


@query(_RUNS + r""", b AS (SELECT *, lag((y0 + y1) // 2) OVER w AS mid, lag(x1) OVER w AS px1, max(x1) OVER (PARTITION BY doc_id, page) AS edge, length(regexp_extract(trim(text), '^(\S*)', 1)) * ((x1 - x0) // greatest(length(trim(text)), 1)) AS word FROM runs WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, ord, coalesce(y0 > mid AND px1 + 2 * word <= edge, false) AS brk FROM b""")
def hard_breaks(spark, sf_dir):
    return L.hard_breaks(V.runs(spark, sf_dir), "doc_id", "page").select("doc_id", "ord", "brk")


@query(_RUNS + " SELECT doc_id, ord, coalesce(2 * (x0 - lag(x0) OVER w) >= y1 - y0 AND 4 * abs(lead(x0) OVER w - lag(x0) OVER w) <= y1 - y0, false) AS cut FROM (SELECT * REPLACE (x0 + (ord % 3 = 1)::INT * 900 - (ord % 4) * 300 AS x0) FROM runs) WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)")
def indent_cuts(spark, sf_dir):
    r = V.runs(spark, sf_dir).withColumn("x0", F.col("x0") + F.when(F.col("ord") % 3 == 1, 900).otherwise(0) - (F.col("ord") % 4) * 300)
    return L.indent_cuts(r, "doc_id", "page").select("doc_id", "ord", "cut")


@query(V.with_views("words") + " SELECT doc_id, ord, w, sum(o) OVER (PARTITION BY doc_id, ord ORDER BY x0, w)::BIGINT AS cell FROM (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY doc_id, ord ORDER BY x0, w) > 1000)::INT, 0) AS o FROM words)")
def line_cells(spark, sf_dir):
    return L.cells_of_lines(V.words(spark, sf_dir), "doc_id", "ord").select("doc_id", "ord", "w", "cell")


@query(V.with_views("words") + " SELECT doc_id, ord, w, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, ord ORDER BY x0, w) < 400, false) AS joins FROM words")
def ink_joins(spark, sf_dir):
    return L.ink_joins(V.words(spark, sf_dir), "doc_id", "ord").select("doc_id", "ord", "w", "joins")


@query(V.with_views("words") + " SELECT doc_id, list_sort(list((x1 - x0) // length(text)))[count(*) // 2 + 1] AS pitch, count(*) AS n FROM words WHERE length(text) > 0 GROUP BY doc_id HAVING count(*) >= 2")
def font_pitch(spark, sf_dir):
    return L.pitch(V.words(spark, sf_dir), "doc_id")
