"""Identity, assurance, search and projection over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators import assure as A
from quire.operators import project as P
from quire.operators import search as S
from quire.plans import views as V
from quire.plans.registry import query

_RUNS = V.with_views("runs")
_FACTS = V.with_views("page_facts")
_TALLY = _FACTS + """, tally AS (SELECT doc, page, count(*) FILTER (op = 'text') AS text_operators, sum(CASE WHEN op = 'text' THEN text_bytes ELSE 0 END)::BIGINT AS text_bytes, count(*) FILTER (op = 'image') AS image_count,
count(*) FILTER (op = 'path') AS path_operators, count(*) FILTER (op = 'path' AND rectangle) AS rectangles, count(*) FILTER (op = 'annotation') AS annotations FROM page_facts GROUP BY ALL)"""


def _tally(spark, sf_dir):
    return A.tally(V.page_facts(spark, sf_dir))


@query(_TALLY + " SELECT * FROM tally")
def page_tally(spark, sf_dir):
    return _tally(spark, sf_dir)


_CODES = """list_sort(list_filter([CASE WHEN text_operators = 0 THEN 'no-text' END, CASE WHEN text_operators = 0 AND image_count > 0 THEN 'scanned' END, CASE WHEN text_operators = 0 AND path_operators >= 2 THEN 'vector-text' END,
CASE WHEN text_operators > 0 AND text_bytes < 20 AND image_count > 0 THEN 'sparse-text' END, CASE WHEN image_count > 0 THEN 'embedded-images' END, CASE WHEN annotations > 0 THEN 'annotation-text' END,
CASE WHEN rectangles >= 1 THEN 'table-likely' END, CASE WHEN path_operators >= 3 THEN 'dense-graphics' END], lambda x: x IS NOT NULL))"""
_REASONS = _TALLY + f", reasons AS (SELECT doc, page, {_CODES} AS reasons FROM tally)"


def _reasons(spark, sf_dir):
    """With thresholds for path operators and rectangles that these small pages reach."""
    return A.reasons(_tally(spark, sf_dir), vector=2, dense=3, tables=1)


@query(_REASONS + " SELECT doc, page, array_to_string(reasons, ',') AS reasons FROM reasons")
def page_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select("doc", "page", F.array_join("reasons", ",").alias("reasons"))


@query(_REASONS + " SELECT doc, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS reasons, count(code) > 0 AS needs_attention FROM (SELECT doc, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS code FROM reasons) GROUP BY doc")
def doc_reasons(spark, sf_dir):
    return A.document_reasons(_reasons(spark, sf_dir)).select("doc", F.array_join("reasons", ",").alias("reasons"), "needs_attention")


@query(_TALLY + " SELECT doc, page, CASE WHEN page <= 5 THEN 'processed' ELSE 'quarantined' END AS state, CASE WHEN page > 5 THEN 'resource-limit-pages' END AS code FROM tally")
def page_budget(spark, sf_dir):
    return A.admit(_tally(spark, sf_dir).select("doc", "page"), 5)


@query(_TALLY + " SELECT doc, page FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM tally) WHERE n <= 3")
def page_sample(spark, sf_dir):
    return A.sample(_tally(spark, sf_dir).select("doc", "page"), 3)


_STATES = _TALLY + """, states AS (SELECT doc, page, CASE WHEN page > 6 THEN 'quarantined' WHEN image_count > 2 THEN 'unsupported' WHEN annotations > 0 THEN 'failed' ELSE 'processed' END AS state,
CASE WHEN page > 6 THEN 'resource-limit-pages' WHEN image_count > 2 THEN 'images-not-emitted' WHEN annotations > 0 THEN 'annotations-not-extracted' END AS code FROM tally),
lim AS (SELECT DISTINCT doc, CASE WHEN page % 2 = 0 THEN page END AS page, CASE WHEN doc % 4 > 0 THEN 'resource-limit-pages' ELSE 'off-page-text' END AS code FROM tally WHERE page > 5)"""


def _states(spark, sf_dir):
    t = _tally(spark, sf_dir)
    pick = lambda a, b, c: F.when(F.col("page") > 6, a).when(F.col("image_count") > 2, b).when(F.col("annotations") > 0, c)
    return t.select("doc", "page", pick("quarantined", "unsupported", "failed").otherwise("processed").alias("state"), pick("resource-limit-pages", "images-not-emitted", "annotations-not-extracted").alias("code"))


def _limits(spark, sf_dir):
    t = _tally(spark, sf_dir).where("page > 5")
    return t.select("doc", F.when(F.col("page") % 2 == 0, F.col("page")).alias("page"), F.when(F.col("doc") % 4 > 0, "resource-limit-pages").otherwise("off-page-text").alias("code"))


@query(_STATES + """ SELECT doc, count(DISTINCT page) AS authorized, count(*) FILTER (state = 'processed') AS processed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'unsupported') AS unsupported,
count(*) FILTER (state = 'quarantined') AS quarantined, count(*) FILTER (state = 'not_attempted') AS not_attempted, true AS reconciles FROM states GROUP BY doc""")
def coverage_summary(spark, sf_dir):
    return A.coverage(_states(spark, sf_dir))


@query(_STATES + " SELECT doc, count(*) FILTER (state <> 'processed') AS pages_not_processed, min(page) FILTER (state <> 'processed') AS first_gap_page, CASE WHEN bool_and(state = 'processed') THEN 'complete' ELSE 'partial' END AS terminal FROM states GROUP BY doc")
def terminal_state(spark, sf_dir):
    return A.terminal_state(_states(spark, sf_dir))


@query(_STATES + " SELECT doc, page, code FROM lim")
def limitation_normalize(spark, sf_dir):
    return A.normalize_limitations(_limits(spark, sf_dir))


@query(_STATES + " SELECT DISTINCT s.doc, s.page, s.state, s.code FROM states s WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lim l WHERE l.doc = s.doc AND l.code = s.code)")
def undeclared_gaps(spark, sf_dir):
    return A.undeclared_gaps(_states(spark, sf_dir), _limits(spark, sf_dir)).select("doc", "page", "state", "code")


@query(_STATES + """, ask AS (SELECT DISTINCT doc, page + 1 AS page FROM tally), sc AS (SELECT doc, page, min(code) AS lc FROM lim WHERE page IS NOT NULL GROUP BY ALL)
SELECT ask.doc, ask.page, CASE WHEN state IS NULL THEN 'out-of-range' WHEN state <> 'processed' THEN state WHEN lc IS NOT NULL THEN 'capability-limited' ELSE 'ok' END AS status FROM ask LEFT JOIN states USING (doc, page) LEFT JOIN sc USING (doc, page)""")
def page_binding(spark, sf_dir):
    ask = _tally(spark, sf_dir).select("doc", (F.col("page") + 1).alias("page"))
    return A.page_binding(ask, _states(spark, sf_dir), _limits(spark, sf_dir))


@query(_RUNS + " SELECT doc_id, ord, (sum(n) OVER w)::BIGINT AS spent, sum(n) OVER w > 2000 AS over FROM (SELECT *, octet_length(encode(text)) AS n FROM runs) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def budget_charge(spark, sf_dir):
    r = V.runs(spark, sf_dir).withColumn("n", F.octet_length("text"))
    return A.charge(r, "n", 2000, "doc_id", order="ord").select("doc_id", "ord", F.col("spent").cast("bigint").alias("spent"), "over")


@query(_RUNS + " SELECT doc_id, count(*) AS n, count(*) > 12 AS withheld FROM runs GROUP BY doc_id")
def spans_withheld(spark, sf_dir):
    return A.withhold(V.runs(spark, sf_dir), 12, "doc_id")


@query("SELECT DISTINCT url AS name FROM pages WHERE page_id % 3 > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def unread_entries(spark, sf_dir):
    e = V.table(spark, sf_dir, "pages").select(F.col("url").alias("name"), "page_id")
    return A.unread(e.where("page_id % 3 > 0").select("name").distinct(), e.where("page_id % 3 = 0"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return A.duplicates(V.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN f & 1 > 0 THEN 'ReadOnly' END, CASE WHEN f & 2 > 0 THEN 'Required' END, CASE WHEN f & 4 > 0 THEN 'NoExport' END, CASE WHEN f & 4096 > 0 THEN 'Multiline' END], lambda x: x IS NOT NULL), ',') AS named,
array_to_string(list_transform(list_filter(generate_series(1, 32), lambda k: k NOT IN (1, 2, 3, 13) AND (f >> (k - 1)::INT) & 1 = 1), lambda k: k::VARCHAR), ',') AS unnamed FROM (SELECT o_orderkey, o_orderkey * 7 % 65536 AS f FROM orders)""")
def flag_bits(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 65536).alias("f"))
    o = A.named_bits(o, "f", {1: "ReadOnly", 2: "Required", 3: "NoExport", 13: "Multiline"})
    return o.select("o_orderkey", F.array_join("named", ",").alias("named"), F.array_join(F.col("unnamed").cast("array<string>"), ",").alias("unnamed"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0)
SELECT coalesce(s.k, c.k) AS k, CASE WHEN s.k IS NULL THEN 'content-only' WHEN c.k IS NULL THEN 'structure-only' ELSE 'bound' END AS status FROM s FULL JOIN c ON s.k = c.k""")
def mcid_binding(spark, sf_dir):
    s = V.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"))
    c = V.table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    return A.bind(s, c, "k")


_OPS = _FACTS + ", ops AS (SELECT page_facts.*, 1 AS one FROM page_facts)"


@query(_FACTS + " SELECT doc, op AS code, count(*) AS n FROM page_facts GROUP BY ALL")
def finding_totals(spark, sf_dir):
    return V.page_facts(spark, sf_dir).groupBy("doc", F.col("op").alias("code")).agg(F.count("*").alias("n"))


# -- identities ---------------------------------------------------------------------------------

@query(_RUNS + " SELECT doc_id, ord, 'e' || row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS id FROM runs")
def node_ids(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "ord"))
    return V.runs(spark, sf_dir).select("doc_id", "ord", F.concat(F.lit("e"), n.cast("string")).alias("id"))


@query(_RUNS + ", c AS (SELECT doc_id, page, count(*) AS n FROM runs GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c) SELECT r.doc_id, ord, base + row_number() OVER (PARTITION BY r.doc_id, r.page ORDER BY ord) AS n FROM runs r JOIN b USING (doc_id, page)")
def rebase_ids(spark, sf_dir):
    """Page-local numbers made document-wide by the counts of the pages before."""
    r = V.runs(spark, sf_dir)
    base = r.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("ord"))
    return r.withColumn("local", local).join(base, ["doc_id", "page"]).select("doc_id", "ord", (F.col("base") + F.col("local")).alias("n"))


@query("SELECT s, row_number() OVER (ORDER BY regexp_extract(s, '^\\D+'), regexp_extract(s, '\\d+$')::BIGINT) AS n FROM (SELECT ['e', 's', 't'][(p_partkey % 3 + 1)::INT] || p_partkey AS s FROM part)")
def id_sort(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.concat(F.element_at(F.array(F.lit("e"), F.lit("s"), F.lit("t")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey").cast("string")).alias("s"))
    # Numbers in stretches of a thousand: a window over the stretches' counts, and one in each stretch.
    p = p.withColumn("kind", F.regexp_extract("s", r"^\D+", 0)).withColumn("k", F.regexp_extract("s", r"\d+$", 0).cast("bigint")).withColumn("part", F.expr("k div 1000"))
    per = p.groupBy("kind", "part").agg(F.count("*").alias("rows"))
    per = per.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("kind", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    return p.withColumn("own", F.row_number().over(W.partitionBy("kind", "part").orderBy("k"))).join(per, ["kind", "part"]).select("s", (F.col("before") + F.col("own")).cast("bigint").alias("n"))


# -- search -------------------------------------------------------------------------------------

def _blocks(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block"), F.coalesce("text", F.lit("")).alias("text"))


def _quotes(spark, sf_dir):
    """Every benchmark text, and one short string that overlaps itself."""
    q = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("quote"), "text")
    return q.unionByName(spark.createDataFrame([(-1, "anan")], "quote bigint, text string"))


def _found(spark, sf_dir):
    return S.locate(_blocks(spark, sf_dir), _quotes(spark, sf_dir))


_FOUND = """WITH quotes AS (SELECT item_id::BIGINT AS quote, text FROM benchmark UNION ALL SELECT -1, 'anan'),
found AS (SELECT doc_id AS block, quote, length(q) AS length, unnest(list_filter(generate_series(1, length(t) - length(q) + 1), lambda i: t[i:i + length(q) - 1] = q)) - 1 AS start FROM (SELECT d.doc_id, quote, d.text AS t, q.text AS q FROM documents d JOIN quotes q ON contains(d.text, q.text)))"""
_MEMBERS = """, lines AS (SELECT doc_id AS block, unnest(t) AS x, generate_subscripts(t, 1)::BIGINT - 1 AS ord, len(t) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)),
mem AS (SELECT block, ord, coalesce(sum(n) OVER (PARTITION BY block ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ms, sum(n) OVER (PARTITION BY block ORDER BY ord)::BIGINT AS me FROM (SELECT block, ord, length(x) + CASE WHEN ord + 1 < k THEN 1 ELSE 0 END AS n FROM lines))"""


def _members(spark, sf_dir):
    """The lines of each document with their line feeds, as members of one block."""
    r = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("t"))
    r = r.select("block", F.size("t").alias("k"), F.posexplode("t").alias("ord", "text"))
    r = r.withColumn("text", F.when(F.col("ord") + 1 < F.col("k"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))).withColumn("ord", F.col("ord").cast("bigint"))
    return S.offsets(r, "block", "ord").select("block", "ord", "m_start", "m_end")


@query(_FOUND + " SELECT block, quote, start, length FROM found")
def locate_quotes(spark, sf_dir):
    return _found(spark, sf_dir)


@query(_FOUND + _MEMBERS + " SELECT f.block, quote, start, ord AS node, greatest(start, ms) - ms AS char_start, least(start + length, me) - ms AS char_end FROM found f JOIN mem m ON m.block = f.block AND ms < start + length AND me > start")
def locate_parts(spark, sf_dir):
    return S.parts(_found(spark, sf_dir), _members(spark, sf_dir))


@query(_FOUND + " SELECT quote, count(*) AS occurrences, count(*) > 10 AS withheld FROM found GROUP BY quote")
def occurrence_ceiling(spark, sf_dir):
    return S.withheld(_found(spark, sf_dir), 10)


@query(_MEMBERS.replace(", lines", "WITH lines", 1) + " SELECT block, ord, ms AS m_start, me AS m_end FROM mem")
def block_offsets(spark, sf_dir):
    return _members(spark, sf_dir)


@query(_RUNS + ", ids AS (SELECT doc_id, 3::BIGINT AS ord FROM documents) SELECT ids.doc_id, ids.ord, text, runs.doc_id IS NOT NULL AS found FROM ids LEFT JOIN runs ON runs.doc_id = ids.doc_id AND runs.ord = ids.ord")
def node_get(spark, sf_dir):
    ids = V.table(spark, sf_dir, "documents").select("doc_id", F.lit(3).cast("bigint").alias("ord"))
    return S.node_get(V.runs(spark, sf_dir).select("doc_id", "ord", "text"), ids)


# -- projections --------------------------------------------------------------------------------

_JOIN = "ord % 3 > 0 AND ord % 40 > 0"
_BLOCKED = _RUNS + f", blocked AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS block FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1 OR {_JOIN} THEN 0 ELSE 1 END AS o FROM runs))"


def _blocked(spark, sf_dir):
    """Three runs to a block, none over a page's end."""
    return P.geometric_blocks(V.runs(spark, sf_dir), F.expr(_JOIN), "doc_id", "ord")


@query(_BLOCKED + " SELECT doc_id, block, string_agg(text, '' ORDER BY ord) AS text, count(*) AS n_runs FROM blocked GROUP BY ALL")
def geometric_blocks(spark, sf_dir):
    return P.block_text(_blocked(spark, sf_dir), "doc_id", "ord")


_SEGS = _RUNS + """, f AS (SELECT doc_id, ord, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1 AS first FROM runs WHERE text <> ''),
u AS (SELECT doc_id, ord, 1 AS k, n, 'source' AS kind, ord AS node FROM f UNION ALL SELECT doc_id, ord, 0, 2, 'syntax', NULL FROM f WHERE NOT first),
segs AS (SELECT doc_id, row_number() OVER w - 1 AS segment, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ord, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s_start, sum(n) OVER w AS s_end, kind, node FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY ord, k))"""


def _segments(spark, sf_dir):
    return P.segments(V.runs(spark, sf_dir), "doc_id", "ord")


@query(_SEGS + " SELECT doc_id, segment, s_start, s_end::BIGINT AS s_end, kind, node FROM segs")
def anchor_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(_SEGS + " SELECT doc_id, count(*) AS n_segments, max(s_end)::BIGINT AS n_bytes, true AS tiles FROM segs GROUP BY doc_id")
def segments_tile(spark, sf_dir):
    return P.tiling(_segments(spark, sf_dir), "doc_id")


_SPANS = ", spans AS (SELECT doc_id, k AS span, k * 37 AS a, k * 37 + 20 + k % 3 * 30 AS b FROM documents, (SELECT unnest(generate_series(0, 5))::BIGINT AS k))"


def _spans(spark, sf_dir):
    k = F.col("span")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("span")).select("doc_id", "span", (k * 37).alias("a"), (k * 37 + 20 + k % 3 * 30).alias("b"))


@query(_SEGS + _SPANS + " SELECT s.doc_id, span, segment, kind FROM spans s JOIN segs g ON g.doc_id = s.doc_id AND s_start < b AND a < s_end")
def segments_touching(spark, sf_dir):
    return S.touching(_segments(spark, sf_dir), _spans(spark, sf_dir), "doc_id")


@query(_SEGS + _SPANS + " SELECT s.doc_id, span, coalesce(bool_and(kind = 'source'), false) AS invertible FROM spans s LEFT JOIN segs g ON g.doc_id = s.doc_id AND s_start < b AND a < s_end GROUP BY ALL")
def is_invertible(spark, sf_dir):
    return S.invertible(_segments(spark, sf_dir), _spans(spark, sf_dir), "doc_id")


_KIND = "CASE ord % 9 WHEN 3 THEN 'FormField' WHEN 5 THEN 'Annotation' WHEN 7 THEN 'Image' ELSE 'TextRun' END"


def _kinds(spark, sf_dir):
    return V.runs(spark, sf_dir).withColumn("kind", F.expr(_KIND))


@query(_RUNS + f", k AS (SELECT doc_id, length(text) AS n, {_KIND} AS kind FROM runs) SELECT doc_id, sum(CASE WHEN kind = 'TextRun' THEN n ELSE 0 END)::BIGINT AS emitted, sum(CASE WHEN kind IN ('FormField', 'Annotation') THEN n ELSE 0 END)::BIGINT AS dropped_forms, sum(CASE WHEN kind = 'Image' THEN n ELSE 0 END)::BIGINT AS dropped_images, sum(n)::BIGINT AS total, true AS balances FROM k GROUP BY doc_id")
def census(spark, sf_dir):
    return P.census(_kinds(spark, sf_dir), "doc_id")


@query(_RUNS + f", k AS (SELECT doc_id, length(text) AS n, CASE {_KIND} WHEN 'FormField' THEN 'form-fields-not-projected' WHEN 'Annotation' THEN 'annotations-not-projected' WHEN 'Image' THEN 'images-not-projected' END AS code FROM runs) SELECT doc_id, code, count(*) AS nodes, sum(n)::BIGINT AS chars FROM k WHERE code IS NOT NULL GROUP BY ALL")
def dropped_kinds(spark, sf_dir):
    return P.dropped(_kinds(spark, sf_dir), "doc_id")


_BOXED = _BLOCKED.replace("blocked AS", "blocked0 AS", 1) + ", blocked AS (SELECT * REPLACE (CASE WHEN ord % 7 < 6 THEN x0 END AS x0) FROM blocked0)"


def _boxed(spark, sf_dir):
    return _blocked(spark, sf_dir).withColumn("x0", F.when(F.col("ord") % 7 < 6, F.col("x0")))


@query(_BOXED + " SELECT doc_id, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_runs FROM blocked WHERE x0 IS NOT NULL GROUP BY ALL")
def ground_elements(spark, sf_dir):
    return P.ground_elements(_boxed(spark, sf_dir), "doc_id")


@query(_BOXED + " SELECT doc_id, block, ord AS node, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, block ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, sum(length(text)) OVER (PARTITION BY doc_id, block ORDER BY ord)::BIGINT AS char_end FROM blocked")
def ground_spans(spark, sf_dir):
    return P.ground_spans(_boxed(spark, sf_dir), "doc_id", "ord")


@query(_BOXED + " SELECT doc_id, count(*) AS total, count(*) FILTER (x0 IS NULL) AS omitted FROM blocked GROUP BY doc_id")
def omission_report(spark, sf_dir):
    return P.omissions(_boxed(spark, sf_dir), "doc_id")


@query(_BOXED + """, el AS (SELECT doc_id, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM blocked WHERE x0 IS NOT NULL GROUP BY ALL),
v AS (SELECT doc_id, 1 AS rule, 'element-box' AS code FROM el WHERE NOT (x1 > x0 AND y1 > y0) UNION ALL SELECT b.doc_id, 3, 'span-element' FROM blocked b WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.doc_id = b.doc_id AND el.block = b.block))
SELECT doc_id, arg_min(code, rule) AS code FROM v GROUP BY doc_id""")
def grounding_violations(spark, sf_dir):
    b = _boxed(spark, sf_dir)
    return P.violations(P.ground_spans(b, "doc_id", "ord"), P.ground_elements(b, "doc_id"), "doc_id")


@query(r"""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN ['h1', 'h6', 'p', 'h7'][event_id % 16 // 4 + 1] END AS e, CASE WHEN event_id % 4 = 1 THEN event_id % 9 END AS o, CASE WHEN event_id % 4 >= 2 THEN ['Document', ['H', 'H3', 'P', 'Lbl'][event_id % 16 // 4 + 1]] END AS path, CASE WHEN event_id % 3 = 0 THEN event_id % 10 END AS inf FROM events)
SELECT id, CASE WHEN e IS NOT NULL THEN CASE e WHEN 'h1' THEN 1 WHEN 'h6' THEN 6 END WHEN o IS NOT NULL THEN CASE WHEN o BETWEEN 1 AND 6 THEN o END ELSE coalesce(CASE path[-1] WHEN 'H' THEN 1 WHEN 'H3' THEN 3 END, CASE WHEN greatest(inf, 1) <= 6 AND inf IS NOT NULL THEN greatest(inf, 1) END) END::INT AS level FROM r""")
def heading_level(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.floor(i % 16 / 4) + 1).cast("int"))
    e = F.when(i % 4 == 0, pick("h1", "h6", "p", "h7"))
    o = F.when(i % 4 == 1, (i % 9).cast("int"))
    path = F.when(i % 4 >= 2, F.array(F.lit("Document"), pick("H", "H3", "P", "Lbl")))
    inf = F.when(i % 3 == 0, (i % 10).cast("int"))
    own = F.when(inf.isNotNull(), inf).otherwise(F.lit(99))
    return V.table(spark, sf_dir, "events").select(i.alias("id"), P.heading_level(e, o, path, own).alias("level"))


@query(r"""WITH r AS (SELECT event_id AS id, list_concat(list_transform(generate_series(1, event_id % 3), lambda k: 'L'), ['LI', ['Lbl', 'LBody', 'P', 'LI'][event_id % 4 + 1]]) AS path FROM events)
SELECT id, CASE WHEN path[-1] IN ('Lbl', 'LBody', 'LI') AND len(list_filter(path, lambda x: x = 'L')) >= 1 THEN path[-1] = 'Lbl' END AS label, CASE WHEN path[-1] IN ('Lbl', 'LBody', 'LI') AND len(list_filter(path, lambda x: x = 'L')) >= 1 THEN len(list_filter(path, lambda x: x = 'L')) - 1 END::INT AS depth FROM r""")
def list_role(spark, sf_dir):
    i = F.col("event_id")
    path = F.concat(F.array_repeat(F.lit("L"), (i % 3).cast("int")), F.array(F.lit("LI"), F.element_at(F.array(F.lit("Lbl"), F.lit("LBody"), F.lit("P"), F.lit("LI")), (i % 4 + 1).cast("int"))))
    return V.table(spark, sf_dir, "events").select(i.alias("id"), P.list_role(path).alias("r")).select("id", "r.label", "r.depth")


@query(_RUNS + r""", h AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN rtrim(text, '.') || '-' ELSE text END AS text FROM runs), n AS (SELECT *, trim(regexp_replace(lead(text) OVER (PARTITION BY doc_id ORDER BY ord), '\s+', ' ', 'g')) AS nxt FROM h)
SELECT doc_id, ord, CASE WHEN regexp_matches(text, '\p{L}-$') AND regexp_matches(nxt, '^\p{L}') THEN text[1:length(text) - 1] || nxt END AS joined FROM n""")
def hyphen_rejoin(spark, sf_dir):
    r = V.runs(spark, sf_dir)
    r = r.withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat(F.rtrim("text", F.lit(".")), F.lit("-"))).otherwise(F.col("text")))
    return P.hyphen_joins(r, "doc_id", order="ord").select("doc_id", "ord", "joined")


_LEVEL = "CASE WHEN em > 1500 THEN 1 WHEN em > 1100 THEN 2 END"


@query(_RUNS + rf""", l AS (SELECT doc_id, ord, {_LEVEL} AS level, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM runs)
SELECT doc_id, coalesce(string_agg(CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' ELSE '' END || t, chr(10) || chr(10) ORDER BY ord) FILTER (t <> ''), '') AS markdown FROM l GROUP BY doc_id""")
def markdown(spark, sf_dir):
    return P.markdown(V.runs(spark, sf_dir).withColumn("level", F.expr(_LEVEL)), "doc_id", "ord")


@query(_RUNS + rf""", l AS (SELECT doc_id, ord, coalesce('h' || {_LEVEL}, 'p') AS tag, replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM runs)
SELECT doc_id, coalesce(string_agg('<' || tag || '>' || t || '</' || tag || '>' || chr(10), '' ORDER BY ord) FILTER (t <> ''), '') AS html FROM l GROUP BY doc_id""")
def html_projection(spark, sf_dir):
    return P.html(V.runs(spark, sf_dir).withColumn("level", F.expr(_LEVEL)), "doc_id", "ord")
