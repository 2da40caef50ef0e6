"""Text rules over lines, and identities over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import strings as S
from quire.plans import views as V
from quire.plans.registry import query

_HEADS = ["• ", "1. ", "(a) ", "12) ", "- ", "", "abc ", "iv. ", "2.1 ", "3.1.4. ", "(IV) ", "* x", "1234. ", " • "]
_HEADS_SQL = "[" + ", ".join("'" + h + "'" for h in _HEADS) + "]"


def _headed(spark, sf_dir):
    """Lines that open in the ways that the rules tell apart."""
    head = F.element_at(F.array(*(F.lit(h) for h in _HEADS)), (F.col("ord") % len(_HEADS) + 1).cast("int"))
    return V.runs(spark, sf_dir).select("doc_id", "ord", F.concat(head, F.col("text")).alias("text"))


_HEADED = V.with_views("runs") + f", headed AS (SELECT doc_id, ord, {_HEADS_SQL}[ord % {len(_HEADS)} + 1] || text AS text FROM runs)\n"
_WS = r"[\s\x{00a0}\x0b]"


@query(V.with_views("runs") + r"SELECT doc_id, ord, trim(regexp_replace('  ' || text || chr(160) || chr(9) || ' x', '[\s\x{00a0}]+', ' ', 'g')) AS text FROM runs")
def normalize_text(spark, sf_dir):
    return V.runs(spark, sf_dir).select("doc_id", "ord", S.normalize(F.concat(F.lit("  "), F.col("text"), F.lit(" \t x"))).alias("text"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", S.html_escape(F.col("html")).alias("escaped"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '&' WHEN 'view' THEN '<' WHEN 'purchase' THEN '>' END AS resolved, event_type NOT IN ('click', 'view', 'purchase') AS refused FROM events")
def resolve_entity(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "amp").when(F.col("event_type") == "view", "lt").when(F.col("event_type") == "purchase", "gt").otherwise(F.col("event_type"))
    return V.table(spark, sf_dir, "events").select("event_id", S.resolve_entity(name).alias("resolved"), S.resolve_entity(name).isNull().alias("refused"))


@query(_HEADED + r"SELECT doc_id, ord, regexp_matches(regexp_replace(text, '^[\s\x{00a0}]+', ''), '^([•·▪◦‣–—*-][\s\x{00a0}]|\(?([0-9]{1,3}|[A-Za-z])[.)][\s\x{00a0}])') AS marker FROM headed")
def list_markers(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", "ord", S.opens_with_marker(F.col("text")).alias("marker"))


@query(_HEADED + r"SELECT doc_id, ord, coalesce(regexp_matches(trim(text, chr(160) || ' '), '^[\p{L}\p{N}]'), false) AND NOT (ord % 3 > 0 AND length(trim(text, chr(160) || ' ')) = 1) AS word FROM headed")
def opens_with_word(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", "ord", S.opens_with_word(F.col("text"), F.col("ord") % 3 + 1).alias("word"))


@query(_HEADED + r""", heads AS (SELECT doc_id, ord, regexp_extract(regexp_replace(text, '^[\s\x{00a0}]+', ''), '^([^\s\x{00a0}]+)[\s\x{00a0}]', 1) AS h FROM headed)
SELECT doc_id, ord, CASE WHEN regexp_matches(h, '^([IVXLCDM]+|[ivxlcdm]+)\.$') THEN 1 WHEN regexp_matches(h, '^[0-9]+(\.[0-9]+)*\.?$') THEN len(string_split(rtrim(h, '.'), '.')) END::INT AS depth FROM heads""")
def section_depth(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", "ord", S.section_number(F.col("text")).alias("depth"))


@query(_HEADED + r""", heads AS (SELECT doc_id, ord, regexp_extract(regexp_replace(text, '^[\s\x{00a0}]+', ''), '^([^\s\x{00a0}]+)[\s\x{00a0}]', 1) AS h FROM headed)
SELECT doc_id, ord, h <> '' AND regexp_matches(h, '^([•·▪◦‣–—*-]|\(?[0-9]+(\.[0-9]+)*[.)]*|\(?([A-Za-z]|[IVXLC]+|[ivxlc]+)[.)]+)$') AS label FROM heads""")
def opens_with_label(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", "ord", S.opens_with_label(F.col("text")).alias("label"))


_PRICE = "format('{}{}{}{}{}', ['', '(', '-', '−', '+'][(l_linenumber % 5 + 1)::INT], ['', '$', '€'][(l_partkey % 3 + 1)::INT], (l_quantity * 1000)::BIGINT, ['', '.5', '.25', '.1234567'][(l_suppkey % 4 + 1)::INT], ['', '%', ' k', 'bn', ')', 'x)', 'q'][(l_orderkey % 7 + 1)::INT])"


def _printed(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), k.cast("int"))
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.concat(
            pick(["", "(", "-", "−", "+"], F.col("l_linenumber") % 5 + 1),
            pick(["", "$", "€"], F.col("l_partkey") % 3 + 1),
            (F.col("l_quantity") * 1000).cast("bigint").cast("string"),
            pick(["", ".5", ".25", ".1234567"], F.col("l_suppkey") % 4 + 1),
            pick(["", "%", " k", "bn", ")", "x)", "q"], F.col("l_orderkey") % 7 + 1),
        ).alias("printed"),
    )


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {_PRICE} AS printed FROM lineitem)," + r"""
g AS (SELECT *, regexp_extract(printed, '^([(\-−–+]?)([$€£¥]?)([0-9]{1,18})(\.[0-9]{1,6})?\s?((?i:%|x|k|m|bn|b|pp)?)(\)?)$', ['lead', 'cur', 'whole', 'dec', 'unit', 'close']) AS x FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, printed, CASE WHEN x.whole <> '' THEN (x.whole || x.dec)::DECIMAL(28,6) * CASE x.unit WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'bn' THEN 1000000000 WHEN 'b' THEN 1000000000 ELSE 1 END::DECIMAL(10,0)
  * CASE WHEN x.lead IN ('-', '−', '–') OR x.lead = '(' AND x.close = ')' THEN -1 ELSE 1 END END::DECIMAL(38,6)::VARCHAR AS value FROM g""")
def chart_numbers(spark, sf_dir):
    return _printed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "printed", S.number(F.col("printed")).cast("string").alias("value"))


@query("SELECT o_orderkey, regexp_matches((o_orderkey % 3000)::VARCHAR, '^(19|20)[0-9]{2}$') AS year FROM orders")
def year_test(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", S.is_year((F.col("o_orderkey") % 3000).cast("string")).alias("year"))


@query(V.with_views("runs") + r"SELECT doc_id, ord, regexp_matches(lower(text[1]) || text[2:], '^\p{Ll}') AND length(text) >= 30 AS prose FROM runs")
def prose_test(spark, sf_dir):
    low = F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))
    return V.runs(spark, sf_dir).select("doc_id", "ord", S.prose(low).alias("prose"))


@query(V.with_views("runs") + r"SELECT doc_id, ord, regexp_matches(rtrim(text || ['', ' . . . ', '...', '..'][ord % 4 + 1]), '([.…] *){3,}$') AS leaders FROM runs")
def leaders_test(spark, sf_dir):
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", " . . . ", "...", ".."))), (F.col("ord") % 4 + 1).cast("int"))
    return V.runs(spark, sf_dir).select("doc_id", "ord", S.ends_with_leaders(F.concat("text", tail)).alias("leaders"))


@query("SELECT p_partkey, regexp_extract(replace(p_name, ' ', '-') || ',Bold', '[-,]([^-,]*)$', 1) AS word FROM part")
def weight_word(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", S.weight_word(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(",Bold"))).alias("word"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jp2' ELSE 'application/octet-stream' END AS media FROM events")
def media_types(spark, sf_dir):
    name = F.element_at(F.array(F.lit("DCTDecode"), F.lit("JPXDecode"), F.lit("FlateDecode")), (F.col("event_id") % 3 + 1).cast("int"))
    return V.table(spark, sf_dir, "events").select("event_id", S.media_type_for(name).alias("media"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'xl/worksheets/s' || c_custkey || '.xml' WHEN 1 THEN 'media/' || c_custkey || '.png' WHEN 2 THEN '' ELSE 'xl/a/b.xml' END AS part FROM customer""")
def resolve_targets(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    target = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("worksheets/./s"), k, F.lit(".xml"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("/media//"), k, F.lit(".png"))).when(F.col("c_custkey") % 4 == 2, F.lit("../../../x.xml")).otherwise(F.lit("c/../a/b.xml"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", S.resolve_target(F.lit("xl/workbook.xml"), target).alias("part"))


@query("""WITH s AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), h AS (SELECT doc_id, hex(b) AS h FROM s)
SELECT doc_id, length(h) // 4 AS n_codes, (length(h) // 2 % 2)::BIGINT AS rest, coalesce(list_sum(list_transform(generate_series(0, length(h) // 4 - 1), lambda i: ('0x' || h[i * 4 + 1 : i * 4 + 4])::BIGINT)), 0)::BIGINT AS code_sum FROM h""")
def split_codes(spark, sf_dir):
    b = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    codes = S.split_codes(b, 2)
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(codes).cast("bigint").alias("n_codes"), (F.octet_length(b) % 2).cast("bigint").alias("rest"), F.aggregate(codes, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("code_sum"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS source_sha256 FROM documents")
def source_sha256(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))


_NODE = """'{"id":"e' || n || '","kind":"TextRun","ordinal":' || n || ',"text":"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't') || '"}'"""


def _nodes(spark, sf_dir):
    n = F.col("ord") + 1
    return V.runs(spark, sf_dir).select("doc_id", "ord", F.concat(F.lit("e"), n.cast("string")).alias("id"), S.json_object({"id": S.json_string(F.concat(F.lit("e"), n.cast("string"))), "kind": F.lit('"TextRun"'), "ordinal": n.cast("string"), "text": S.json_string(F.col("text"))}).alias("json"))


@query(V.with_views("runs") + f"SELECT doc_id, ord, {_NODE} AS json FROM (SELECT *, ord + 1 AS n FROM runs)")
def canonical_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("doc_id", "ord", "json")


@query(V.with_views("runs") + f"SELECT doc_id, sha256('[' || string_agg({_NODE}, ',' ORDER BY ord) || ']') AS fingerprint, count(*) AS n_nodes FROM (SELECT *, ord + 1 AS n FROM runs) GROUP BY doc_id")
def payload_fingerprint(spark, sf_dir):
    per = _nodes(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("nodes"))
    return per.select("doc_id", F.sha2(F.concat(F.lit("["), F.array_join(F.col("nodes.json"), ","), F.lit("]")), 256).alias("fingerprint"), F.size("nodes").cast("bigint").alias("n_nodes"))


@query("SELECT vec_id, i, CASE WHEN abs(round(v * 100)) <= 9007199254740991 THEN round(v * 100)::BIGINT END AS q FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 36 AS v, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings)")
def quantize_points(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), G.quantize(F.col("v").cast("double") * 36).alias("q"))


@query(V.with_views("boxes") + "SELECT page, id, x1 > x0 AND y1 > y0 AS valid FROM boxes")
def rect_check(spark, sf_dir):
    return V.boxes(spark, sf_dir).select("page", "id", G.is_rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("valid"))


@query(V.with_views("boxes") + "SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY page")
def rect_union(spark, sf_dir):
    b = V.boxes(spark, sf_dir).where(G.is_rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return b.groupBy("page").agg(G.union().alias("u")).select("page", "u.*")


@query(V.with_views("boxes") + """SELECT page, id, CASE id % 4 WHEN 1 THEN y0 WHEN 2 THEN 61200 - x1 WHEN 3 THEN 79200 - y1 ELSE x0 END AS x0, CASE id % 4 WHEN 1 THEN x0 WHEN 2 THEN y0 WHEN 3 THEN 61200 - x1 ELSE 79200 - y1 END AS y0,
CASE id % 4 WHEN 1 THEN y1 WHEN 2 THEN 61200 - x0 WHEN 3 THEN 79200 - y0 ELSE x1 END AS x1, CASE id % 4 WHEN 1 THEN x1 WHEN 2 THEN y1 WHEN 3 THEN 61200 - x0 ELSE 79200 - y0 END AS y1 FROM boxes""")
def top_left_flip(spark, sf_dir):
    return V.boxes(spark, sf_dir).select("page", "id", G.top_left(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(61200), F.lit(79200), (F.col("id") % 4) * 90).alias("b")).select("page", "id", "b.*")


@query(V.with_views("boxes") + "SELECT page, id, 2 * (3 * x0 - y0 + 7) + y1 AS u, 2 * (x0 + 4 * y0 - 2) - x1 AS v FROM boxes")
def matrix_maps(spark, sf_dir):
    k = lambda *v: [F.lit(x) for x in v]
    m = G.compose(k(3, 1, -1, 4, 7, -2), [*k(2, 0, 0, 2), F.col("y1"), -F.col("x1")])
    x, y = G.apply(m, F.col("x0"), F.col("y0"))
    return V.boxes(spark, sf_dir).select("page", "id", x.alias("u"), y.alias("v"))
