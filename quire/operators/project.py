"""Projections: blocks of runs, text with an anchor map, Markdown and HTML, grounding, census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import strings as S


def geometric_blocks(runs: DataFrame, joins: Column, doc: str, order: str) -> DataFrame:
    """Runs with block, numbered from 0: a run that doesn't join the one before opens the next."""
    w = W.partitionBy(doc).orderBy(order)
    opens = F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return runs.withColumn("__opens", opens).withColumn("block", F.sum("__opens").over(w).cast("bigint")).drop("__opens")


def block_text(blocked: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, block, text, n_runs): members' texts in order, nothing between them."""
    per = blocked.groupBy(doc, "block").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("m"))
    return per.select(doc, "block", F.array_join(F.col("m.text"), "").alias("text"), F.size("m").cast("bigint").alias("n_runs"))


def segments(blocked: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, segment, s_start, s_end, kind, node): byte intervals that tile the projected text of a document.

    Each block's text is a source segment; a syntax segment of two line feeds
    stands between blocks. Empty texts have no segment.
    """
    full = blocked.where(F.octet_length("text") > 0)
    first = F.row_number().over(W.partitionBy(doc).orderBy(order)) == 1
    sep = full.withColumn("__first", first)
    both = sep.select(doc, order, F.lit(1).alias("k"), F.octet_length("text").cast("bigint").alias("n"), F.lit("source").alias("kind"), F.col(order).alias("node")).unionByName(
        sep.where(~F.col("__first")).select(doc, order, F.lit(0).alias("k"), F.lit(2).cast("bigint").alias("n"), F.lit("syntax").alias("kind"), F.lit(None).cast("bigint").alias("node"))
    )
    w = W.partitionBy(doc).orderBy(order, "k")
    start = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return both.select(doc, (F.row_number().over(w) - 1).cast("bigint").alias("segment"), start.alias("s_start"), (start + F.col("n")).alias("s_end"), "kind", "node")


def tiling(segs: DataFrame, doc: str) -> DataFrame:
    """(doc, n_segments, n_bytes, tiles): contiguous, from 0, none empty."""
    w = W.partitionBy(doc).orderBy("segment")
    both = segs.withColumn("__p", F.lag("s_end").over(w))
    return both.groupBy(doc).agg(F.count("*").alias("n_segments"), F.max("s_end").alias("n_bytes"), F.bool_and((F.col("s_end") > F.col("s_start")) & (F.col("s_start") == F.coalesce("__p", F.lit(0)))).alias("tiles"))


def census(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, emitted, dropped_forms, dropped_images, total, balances): characters by what became of them."""
    n = F.length("text")
    by = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), n).otherwise(0))
    per = nodes.groupBy(doc).agg(by("TextRun").alias("emitted"), by("FormField", "Annotation").alias("dropped_forms"), by("Image").alias("dropped_images"), F.sum(n).alias("total"))
    return per.withColumn("balances", F.col("emitted") + F.col("dropped_forms") + F.col("dropped_images") == F.col("total"))


def dropped(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, code, nodes, chars): what isn't text, left out and counted."""
    code = F.when(F.col("kind") == "FormField", "form-fields-not-projected").when(F.col("kind") == "Annotation", "annotations-not-projected").when(F.col("kind") == "Image", "images-not-projected")
    return nodes.withColumn("code", code).where("code is not null").groupBy(doc, "code").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"))


def ground_elements(blocked: DataFrame, doc: str) -> DataFrame:
    """(doc, block, x0, y0, x1, y1, n_runs): the box around each block's measured runs; blocks without one are omitted."""
    return blocked.where("x0 is not null").groupBy(doc, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_runs"))


def ground_spans(blocked: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, block, node, char_start, char_end): each run's place in its element's text."""
    w = W.partitionBy(doc, "block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint")
    return blocked.select(doc, "block", F.col(order).alias("node"), start.alias("char_start"), (start + F.length("text")).alias("char_end"))


def omissions(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, total, omitted): nodes, and those without a box."""
    return nodes.groupBy(doc).agg(F.count("*").alias("total"), F.count_if(F.col("x0").isNull()).alias("omitted"))


def heading_level(element: Column, odf_level: Column, role_path: Column, inferred: Column) -> Column:
    """XHTML h1-h6, then an ODF outline level, then the last tagged role, then the inferred level; six at most."""
    xhtml = F.when(element.rlike("^h[1-6]$"), F.substr(element, F.lit(2), F.lit(1)).cast("int"))
    odf = F.when(odf_level.between(1, 6), odf_level)
    last = F.try_element_at(role_path, F.lit(-1))
    role = F.when(last.isin("H", "H1"), F.lit(1)).when(last.rlike("^H[2-6]$"), F.substr(last, F.lit(2), F.lit(1)).cast("int"))
    own = F.when(F.greatest(inferred, F.lit(1)) <= 6, F.greatest(inferred, F.lit(1)))
    return F.when(element.isNotNull(), xhtml).when(odf_level.isNotNull(), odf).otherwise(F.coalesce(role, own))


def list_role(role_path: Column) -> Column:
    """(label, depth) of a tagged list item; null for other roles, and where no list stands above."""
    last = F.try_element_at(role_path, F.lit(-1))
    depth = F.size(F.filter(role_path, lambda r: r == "L")) - 1
    return F.when(last.isin("Lbl", "LBody", "LI") & (depth >= 0), F.struct((last == "Lbl").alias("label"), depth.alias("depth")))


def hyphen_joins(lines: DataFrame, *group: str, order: str) -> DataFrame:
    """Lines with joined: the word put together over a hyphen at the line's end, null where none is."""
    nxt = F.lead("text").over(W.partitionBy(*group).orderBy(order))
    fits = F.col("text").rlike(r"\p{L}-$") & S.normalize(nxt).rlike(r"^\p{L}")
    return lines.withColumn("joined", F.when(fits, F.concat(F.expr("substring(text, 1, length(text) - 1)"), S.normalize(nxt))))


def markdown(blocked: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, markdown): blocks in order, headings with their signs, two line feeds between; empty blocks leave nothing."""
    text = S.normalize(F.col("text"))
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), text)).otherwise(text)
    per = blocked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(text != "", line).alias("line")))).alias("m"))
    return per.select(doc, F.array_join(F.filter(F.col("m.line"), lambda x: x.isNotNull()), "\n\n").alias("markdown"))


def html(blocked: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, html): paragraphs and headings in order, escaped."""
    text = S.html_escape(S.normalize(F.col("text")))
    tag = F.when(F.col("level").isNotNull(), F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise(F.lit("p"))
    line = F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">\n"))
    per = blocked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(text != "", line).alias("line")))).alias("m"))
    return per.select(doc, F.array_join(F.filter(F.col("m.line"), lambda x: x.isNotNull()), "").alias("html"))


def violations(spans: DataFrame, elements: DataFrame, doc: str) -> DataFrame:
    """(doc, code): the first rule that a grounding source breaks, by the order of the rules."""
    rules = [
        elements.where("not (x1 > x0 and y1 > y0)").select(doc, F.lit(1).alias("rule"), F.lit("element-box").alias("code")),
        spans.where("char_end < char_start").select(doc, F.lit(2).alias("rule"), F.lit("span-offsets").alias("code")),
        spans.join(elements.select(doc, "block"), [doc, "block"], "left_anti").select(doc, F.lit(3).alias("rule"), F.lit("span-element").alias("code")),
    ]
    both = rules[0].unionByName(rules[1]).unionByName(rules[2])
    return both.groupBy(doc).agg(F.min_by("code", "rule").alias("code"))
