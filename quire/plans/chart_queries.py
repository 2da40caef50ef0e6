"""Charts, drawn and tagged tables, headings, sealing: rules of quire.operators.charts over derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import strings as S
from quire.operators import charts as C
from quire.operators import tables as T
from quire.plans import views as V
from quire.plans.registry import query

_RUNS = V.with_views("runs")
_BOXES = V.with_views("boxes") + ", b AS (SELECT * FROM boxes WHERE x1 > x0 AND y1 > y0)"
_CELLS = V.with_views("cells")


@query("SELECT vec_id, CASE WHEN len(c) = 4 THEN list_bool_and(list_transform(c, lambda x: x = 0)) ELSE list_bool_and(list_transform(c, lambda x: x = 1)) END AS white FROM (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN [g] WHEN 1 THEN [g, 1.0, h] WHEN 2 THEN [1 - g, 0.0, 0.0, 1 - h] ELSE [h, h, h] END AS c FROM (SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS g, CASE WHEN embedding[2] > 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS h FROM embeddings))")
def white_fill(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    g, h = (F.when(F.element_at("embedding", i) > 0, 1.0).otherwise(x) for i, x in ((1, 0.5), (2, 0.25)))
    colour = F.when(F.col("vec_id") % 4 == 0, F.array(g)).when(F.col("vec_id") % 4 == 1, F.array(g, F.lit(1.0), h)).when(F.col("vec_id") % 4 == 2, F.array(1 - g, F.lit(0.0), F.lit(0.0), 1 - h)).otherwise(F.array(h, h, h))
    return e.select("vec_id", C.is_white(colour).alias("white"))


def _swatches(spark, sf_dir):
    """Every fourth box is a swatch with a colour, its two followers labels, the fourth a series with nearly a swatch's colour."""
    b = V.boxes(spark, sf_dir).where("x1 > x0 and y1 > y0")
    tint = F.expr("cast((id div 4) % 7 as double) / 10 + case when id % 4 = 3 then cast((id div 4) % 3 as double) * 0.004 else 0 end")
    b = b.withColumn("colour", F.array(tint, F.lit(0.5), F.lit(0.25)))
    s = b.where("id % 4 = 0").withColumnRenamed("id", "swatch")
    labels = b.where("id % 4 in (1, 2)").withColumnRenamed("id", "label").drop("colour")
    return s, labels, b.where("id % 4 = 3").select("page", F.col("id").alias("series"), "colour")


_TINT = "(id // 4 % 7)::DOUBLE / 10 + CASE WHEN id % 4 = 3 THEN (id // 4 % 3)::DOUBLE * 0.004 ELSE 0 END"


@query(_BOXES + f""", t AS (SELECT *, {_TINT} AS tint FROM b), beside AS (SELECT s.page, s.id AS swatch, min(l.id) AS label FROM t s JOIN t l ON s.page = l.page AND s.id % 4 = 0 AND l.id % 4 IN (1, 2) AND l.x0 >= s.x1 AND l.x0 - s.x1 <= s.x1 - s.x0 AND l.y0 < s.y1 AND s.y0 < l.y1 GROUP BY ALL HAVING count(*) = 1),
own AS (SELECT p.page, p.id AS series, min(s.id) AS swatch FROM t p JOIN t s ON p.page = s.page AND p.id % 4 = 3 AND s.id % 4 = 0 AND abs(p.tint - s.tint) <= 0.005 GROUP BY ALL HAVING count(*) = 1)
SELECT own.page, series, label FROM own JOIN beside USING (page, swatch)""")
def legend_labels(spark, sf_dir):
    s, labels, series = _swatches(spark, sf_dir)
    return C.legend(s, labels, series, "page")


@query("""WITH e AS (SELECT vec_id // 12 AS page, vec_id AS id, floor(embedding[1]::DOUBLE * 100000)::BIGINT AS x, floor(embedding[2]::DOUBLE * 100000)::BIGINT AS y FROM embeddings),
s AS (SELECT page, id AS slice, (id % 12) * 60 AS lo, (id % 12) * 60 + 60 AS hi FROM e WHERE id % 12 < 6), l AS (SELECT page, id AS label, CASE WHEN t < 0 THEN t + 360 ELSE t END AS a FROM (SELECT *, degrees(atan2(y::DOUBLE, x::DOUBLE)) AS t FROM e WHERE id % 12 >= 6)),
m AS (SELECT s.page, slice, label FROM s JOIN l ON s.page = l.page AND a >= lo AND a < hi)
SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY page, slice) = 1 AND count(*) OVER (PARTITION BY page, label) = 1""")
def slice_labels(spark, sf_dir):
    q = lambda i: F.floor(F.element_at("embedding", i).cast("double") * 100000).cast("bigint")
    e = V.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 12").alias("page"), F.col("vec_id").alias("id"), q(1).alias("x"), q(2).alias("y"))
    k = F.col("id") % 12
    slices = e.where(k < 6).select("page", F.col("id").alias("slice"), F.lit(0).alias("cx"), F.lit(0).alias("cy"), (k * 60).alias("from"), (k * 60 + 60).alias("to"))
    return C.slice_labels(slices, e.where(k >= 6).select("page", F.col("id").alias("label"), "x", "y"), "page")


@query("SELECT signature, min(l_orderkey) AS first, count(*) AS charts FROM (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus || l_linenumber, '|' ORDER BY l_returnflag || l_linestatus || l_linenumber) AS signature FROM lineitem GROUP BY l_orderkey) GROUP BY signature")
def small_multiples(spark, sf_dir):
    x = V.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("label"))
    return C.small_multiples(x, "l_orderkey", "label")


@query(_RUNS + """, l AS (SELECT doc_id, page, ord AS label, CASE WHEN doc_id % 2 = 0 THEN rtrim(text, '.') ELSE text END AS text, x0, y0, x1, y1, y1 - y0 AS h, lag(y1) OVER w AS up, lead(y0) OVER w AS down FROM runs WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, y1, ord)),
c AS (SELECT doc_id, page, min(y0) AS top FROM runs WHERE ord % 40 >= doc_id % 9 + 1 GROUP BY ALL),
n AS (SELECT l.*, coalesce(up <= y0, true) AND coalesce(down >= y1, true) AND coalesce(y0 - up > h / 2, true) AS alone, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, label DESC) AS k FROM l JOIN c USING (doc_id, page) WHERE y1 <= top AND top - y1 <= 4 * h AND x0 < 40000 AND 7000 < x1)
SELECT doc_id, page, label FROM n WHERE k = 1 AND alone AND NOT ends_with(text, '.')""")
def chart_title(spark, sf_dir):
    r = V.runs(spark, sf_dir)
    charts = r.where("ord % 40 >= doc_id % 9 + 1").groupBy("doc_id", "page").agg(F.min("y0").alias("top")).withColumns({"left": F.lit(7000), "right": F.lit(40000)})
    r = r.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.rtrim("text", F.lit("."))).otherwise(F.col("text")))
    return C.chart_title(charts, r.withColumnRenamed("ord", "label"), "doc_id", "page")


def _drawn(spark, sf_dir):
    """Cells of order tables as boxes: columns 9,000 wide, rows 1,500 high, edges off by up to 80; empty grid slots of every second table are filled."""
    c = V.cells(spark, sf_dir).where("r < 3 and c < 3")
    off = F.length("text") % 3 * 40
    grid = c.select("tbl").distinct().where("tbl % 2 = 0").select("tbl", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r")).select("tbl", "r", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    owned = T.cover(c).select("tbl", F.col("sr").alias("r"), F.col("sc").alias("c"))
    free = grid.join(owned, ["tbl", "r", "c"], "left_anti").select("tbl", "r", "c", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(0).alias("off"))
    both = c.select("tbl", "r", "c", "rowspan", "colspan", off.alias("off")).unionByName(free)
    return both.select("tbl", (F.col("c") * 9000 + F.col("off")).cast("bigint").alias("x0"), (F.col("r") * 1500 + F.col("off")).cast("bigint").alias("y0"), ((F.col("c") + F.col("colspan")) * 9000).cast("bigint").alias("x1"), ((F.col("r") + F.col("rowspan")) * 1500).cast("bigint").alias("y1"))


_FOLD = "list_reduce(list_transform(list_sort(list_distinct({})), lambda v: [v]), lambda a, v: CASE WHEN v[1] - a[len(a)] > 150 THEN list_append(a, v[1]) ELSE a END)"


@query(_CELLS + f""", k AS (SELECT * FROM cells WHERE r < 3 AND c < 3), o AS (SELECT DISTINCT tbl, sr AS r, unnest(generate_series(c, c + colspan - 1)) AS c FROM (SELECT *, unnest(generate_series(r, r + rowspan - 1)) AS sr FROM k)),
g AS (SELECT tbl, r, unnest([0, 1, 2]) AS c FROM (SELECT DISTINCT tbl, unnest([0, 1, 2]) AS r FROM k WHERE tbl % 2 = 0)),
d AS (SELECT tbl, r, c, rowspan, colspan, length(text) % 3 * 40 AS off FROM k UNION ALL SELECT tbl, r, c, 1, 1, 0 FROM g ANTI JOIN o USING (tbl, r, c)),
b AS (SELECT tbl, c * 9000 + off AS x0, r * 1500 + off AS y0, (c + colspan) * 9000 AS x1, (r + rowspan) * 1500 AS y1, row_number() OVER () AS id FROM d),
f AS (SELECT tbl, {_FOLD.format('list(x0) || list(x1)')} AS xs, {_FOLD.format('list(y0) || list(y1)')} AS ys FROM b GROUP BY tbl),
p AS (SELECT b.tbl, len(list_filter(xs, lambda x: x <= x0)) AS i0, len(list_filter(xs, lambda x: x <= x1)) AS i1, len(list_filter(ys, lambda y: y <= y0)) AS j0, len(list_filter(ys, lambda y: y <= y1)) AS j1 FROM b JOIN f USING (tbl)),
q AS (SELECT tbl, i, unnest(generate_series(j0, j1 - 1)) AS j FROM (SELECT *, unnest(generate_series(i0, i1 - 1)) AS i FROM p WHERE i1 > i0 AND j1 > j0)),
n AS (SELECT tbl, count(*) AS covered, max(n) AS most FROM (SELECT tbl, i, j, count(*) AS n FROM q GROUP BY ALL) GROUP BY tbl)
SELECT tbl, (len(ys) - 1)::BIGINT AS n_rows, (len(xs) - 1)::BIGINT AS n_cols, CASE WHEN (len(xs) - 1) * (len(ys) - 1) < 2 THEN 'none' WHEN (len(xs) - 1) * (len(ys) - 1) > 4096 THEN 'too-many-faces' WHEN coalesce(covered, 0) < (len(xs) - 1) * (len(ys) - 1) THEN 'uncovered-face' WHEN most > 1 THEN 'overlap' END AS refusal FROM f LEFT JOIN n USING (tbl)""")
def ruled_lattice(spark, sf_dir):
    return C.ruled(_drawn(spark, sf_dir), "tbl")


@query(_CELLS + " SELECT tbl, cell, r, coalesce(sum(colspan) OVER (PARTITION BY tbl, r ORDER BY c, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"column\" FROM cells")
def tagged_grid(spark, sf_dir):
    return C.tagged_grid(V.cells(spark, sf_dir)).select("tbl", "cell", "r", F.col("column").cast("bigint").alias("column"))


@query(_CELLS + """, u AS (SELECT tbl, r AS sr, c, colspan, rowspan, text FROM cells),
t AS (SELECT DISTINCT tbl, sr, unnest(generate_series(c, c + CASE WHEN text::BIGINT % 5 = 0 THEN 1 ELSE colspan END - 1)) AS sc FROM (SELECT tbl, c, colspan, text, unnest(generate_series(r, r + rowspan - 1)) AS sr FROM cells)),
d AS (SELECT DISTINCT tbl, sr, unnest(generate_series(c, c + colspan - 1)) AS sc FROM (SELECT tbl, c, colspan, unnest(generate_series(r, r + CASE WHEN text::BIGINT % 3 = 0 THEN 1 ELSE rowspan END - 1)) AS sr FROM cells))
SELECT *, 'tagged' AS side FROM (SELECT * FROM t EXCEPT SELECT * FROM d) UNION ALL SELECT *, 'drawn' FROM (SELECT * FROM d EXCEPT SELECT * FROM t)""")
def tagged_difference(spark, sf_dir):
    """Tags state one column where text is a multiple of five, the drawing one row where it is one of three."""
    c, n = V.cells(spark, sf_dir), F.col("text").cast("bigint")
    one = F.lit(1).cast("bigint")
    return C.tagged_difference(T.slots(c.withColumn("colspan", F.when(n % 5 == 0, one).otherwise(F.col("colspan")))), T.slots(c.withColumn("rowspan", F.when(n % 3 == 0, one).otherwise(F.col("rowspan")))))


@query(V.with_views("words") + r""", n AS (SELECT doc_id, ord, w, CASE WHEN w = 0 AND ord % 4 = 0 THEN (ord % 9) || '.' || (ord % 5) ELSE text END AS text, x0, x1 FROM words),
g AS (SELECT *, x0 - lag(x1) OVER l AS gap, lag(text) OVER l AS before, row_number() OVER l AS k FROM n WINDOW l AS (PARTITION BY doc_id, ord ORDER BY w))
SELECT doc_id, ord, w, coalesce(regexp_matches(before, '^[0-9]+(\.[0-9]+)*\.?$') AND k = 2 AND gap >= 0 AND gap <= 3 * CASE WHEN ord % 8 = 0 THEN 50 ELSE 1000 END AND NOT regexp_matches(text, '^[0-9]+(\.[0-9]+)*\.?$'), false) AS continues FROM g""")
def heading_numbers(spark, sf_dir):
    w = V.words(spark, sf_dir)
    text = F.when((F.col("w") == 0) & (F.col("ord") % 4 == 0), F.concat((F.col("ord") % 9).cast("string"), F.lit("."), (F.col("ord") % 5).cast("string"))).otherwise(F.col("text"))
    return C.numbered_headings(w.withColumn("text", text).withColumn("height", F.when(F.col("ord") % 8 == 0, 50).otherwise(1000)), "doc_id", "ord", order="w").select("doc_id", "ord", "w", "continues")


@query("""SELECT conv_id, turn, 'e' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, '{"paragraph":' || turn || ',"part":"' || replace(replace(role, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}' AS locator, length(text) AS n_chars FROM conversations""")
def page_less_ground(spark, sf_dir):
    """Elements of a source without pages: a locator, and no box."""
    from pyspark.sql import Window as W

    c = V.table(spark, sf_dir, "conversations")
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.concat(F.lit("e"), number.cast("string")).alias("id"), S.json_object({"paragraph": F.col("turn").cast("string"), "part": S.json_string(F.col("role"))}).alias("locator"), F.length("text").cast("bigint").alias("n_chars"))


@query("""SELECT n_nationkey, sha256('{"ceiling":' || n_nationkey * 100 || ',"name":"' || n_name || '","tolerance":' || n_regionkey + 150 || '}') AS profile FROM nation""")
def profile_hash(spark, sf_dir):
    """The identity of all settings that the output depends on: the hash of their canonical object."""
    n = V.table(spark, sf_dir, "nation")
    body = S.json_object({"name": S.json_string(F.col("n_name")), "ceiling": (F.col("n_nationkey") * 100).cast("string"), "tolerance": (F.col("n_regionkey") + 150).cast("string")})
    return n.select("n_nationkey", F.sha2(body, 256).alias("profile"))


@query(_RUNS + " SELECT doc_id, ord, coalesce(CASE WHEN ord % 3 = 0 THEN reverse(text) END, text) AS reading FROM runs WHERE text <> ''")
def reading_text(spark, sf_dir):
    """What a node reads as: its own reading where it has one, else its text."""
    r = V.runs(spark, sf_dir).where("text <> ''").withColumn("reading", F.when(F.col("ord") % 3 == 0, F.struct(F.reverse("text").alias("text"))))
    return r.select("doc_id", "ord", F.coalesce("reading.text", "text").alias("reading"))


@query(_RUNS + " SELECT doc_id, page, string_agg(ord, ',' ORDER BY em, ord) AS ords FROM runs GROUP BY ALL")
def stream_order(spark, sf_dir):
    """Within a group what was drawn first comes first."""
    per = V.runs(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("em", "ord"))).alias("s"))
    return per.select("doc_id", "page", F.array_join(F.transform("s.ord", lambda o: o.cast("string")), ",").alias("ords"))


_FAULTY = """, n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 AND ord = 1 THEN 'e1' ELSE 'e' || (ord + 1) END AS id, CASE WHEN doc_id % 6 = 2 AND ord = 0 THEN 'e0' WHEN ord > 0 THEN 'e1' END AS parent, CASE WHEN doc_id % 6 = 3 AND ord > 1 THEN ord + 2 ELSE ord + 1 END AS ordinal, CASE WHEN doc_id % 6 = 4 AND ord = 2 THEN 0 ELSE page END AS page FROM runs)"""


@query(_RUNS + _FAULTY + """, k AS (SELECT *, row_number() OVER w AS n, lag(page) OVER w AS before FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, id)),
v AS (SELECT doc_id, 'id-twice' AS rule FROM n GROUP BY doc_id, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'parent-missing' FROM n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.id = n.parent)
  UNION ALL SELECT doc_id, 'ordinal-gap' FROM k WHERE ordinal <> n UNION ALL SELECT doc_id, 'page-range' FROM n WHERE page < 1 UNION ALL SELECT doc_id, 'page-order' FROM k WHERE page < before)
SELECT doc_id, rule, count(*) AS n FROM v GROUP BY ALL""")
def seal_violations(spark, sf_dir):
    """Representations in which something was broken on purpose, by the document's number."""
    d, o = F.col("doc_id") % 6, F.col("ord")
    own = F.concat(F.lit("e"), (o + 1).cast("string"))
    nodes = V.runs(spark, sf_dir).select(
        "doc_id",
        F.when((d == 1) & (o == 1), F.lit("e1")).otherwise(own).alias("id"),
        F.when((d == 2) & (o == 0), F.lit("e0")).when(o > 0, F.lit("e1")).alias("parent"),
        F.when((d == 3) & (o > 1), o + 2).otherwise(o + 1).alias("ordinal"),
        F.when((d == 4) & (o == 2), F.lit(0)).otherwise(F.col("page")).alias("page"),
    )
    return C.seal(nodes, "doc_id")
