"""Layout rules over runs: lines, leading, slabs, blocks, columns, furniture, headings.

Runs have integer boxes. Every order has a total tiebreak, so results don't
depend on partitions. Groups are pages or documents; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values of the rules, in hundredths of a point.
LINE_TOLERANCE = 150
GAP_BIN = 10
MIN_LEADING = 600
MIN_SHARE = 4
CUT_NUM, CUT_DEN = 8, 5
COLUMN_GUTTER = 1200
BLOCK_GUTTER = 600
MARGIN_ONE_IN = 10
EM_BIN = 10
BODY_SHARE, BODY_LINES = 20, 10
HEADING_NUM, HEADING_DEN = 6, 5
MAX_LEVEL = 6
LABEL_RECURS = 3
SHORT_LINE = 10


def fold(values: Column, tolerance: int = LINE_TOLERANCE) -> Column:
    """Sorted distinct anchors: a value joins the last anchor while within ``tolerance`` of it, so anchors don't chain."""
    empty = F.slice(F.array_sort(values), 1, 0)
    return F.aggregate(F.array_sort(F.array_distinct(values)), empty, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > tolerance), F.concat(acc, F.array(v))).otherwise(acc))


def lines(runs: DataFrame, *group: str) -> DataFrame:
    """(group.., line, y): the baselines of each group, numbered from 0 downwards."""
    per = runs.groupBy(*group).agg(fold(F.collect_set("y0")).alias("ys"))
    return per.select(*group, F.posexplode("ys").alias("line", "y"))


def leading(line: DataFrame, *group: str) -> DataFrame:
    """(group.., leading): the commonest binned gap, the smaller of equals; only where it is large and common enough."""
    w = W.partitionBy(*group).orderBy("line")
    gaps = line.withColumn("gap", F.col("y") - F.lag("y").over(w)).where(F.col("gap").isNotNull())
    bins = gaps.groupBy(*group, F.expr(f"(gap + {GAP_BIN // 2}) div {GAP_BIN} * {GAP_BIN}").alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy(*group).agg(F.sum("n").alias("total"), F.max("n").alias("best"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("leading"))
    return best.where((F.col("leading") >= MIN_LEADING) & (MIN_SHARE * F.col("best") >= F.col("total"))).select(*group, "leading")


def slabs(line: DataFrame, lead: DataFrame, *group: str) -> DataFrame:
    """Lines with slab: how many gaps of 8/5 of the leading or more lie above."""
    w = W.partitionBy(*group).orderBy("line")
    both = line.join(lead, list(group), "left").withColumn("gap", F.col("y") - F.lag("y").over(w))
    cut = F.coalesce((CUT_DEN * F.col("gap") >= CUT_NUM * F.col("leading")).cast("int"), F.lit(0))
    return both.withColumn("cut", cut).select(*group, "line", "y", F.sum("cut").over(w).cast("bigint").alias("slab"))


def line_of(runs: DataFrame, line: DataFrame, *group: str) -> DataFrame:
    """Runs with the last line at or above their baseline."""
    tops = line.groupBy(*group).agg(F.array_sort(F.collect_list("y")).alias("ys"))
    at = F.greatest(F.size(F.filter("ys", lambda y: y <= F.col("y0"))) - 1, F.lit(0))
    return runs.join(tops, list(group)).withColumn("line", at).drop("ys")


def blocks(runs: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    """Runs with slab and block: slabs numbered by first appearance along the order; null where there is only one."""
    line = lines(runs, *group)
    slab = slabs(line, leading(line, *group), *group).drop("y")
    both = line_of(runs, line, *group).join(slab, [*group, "line"])
    per = W.partitionBy(*group, "slab")
    first = both.withColumn("first", F.min(order).over(per))
    out = first.withColumn("block", F.dense_rank().over(W.partitionBy(*group).orderBy("first")))
    many = F.max("block").over(W.partitionBy(*group)) > 1
    return out.withColumn("block", F.when(many, F.col("block"))).drop("first")


def column_bands(atoms: DataFrame, *group: str, gutter: int = COLUMN_GUTTER, tie: str = "ord") -> DataFrame:
    """Atoms with band: a new one opens where an atom starts ``gutter`` or more right of all before it."""
    w = W.partitionBy(*group).orderBy("x0", "x1", tie)
    edge = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    both = atoms.withColumn("opens", F.coalesce((F.col("x0") - edge >= gutter).cast("int"), F.lit(0)))
    return both.withColumn("band", F.sum("opens").over(w).cast("bigint")).drop("opens")


def side_by_side(banded: DataFrame, *group: str) -> DataFrame:
    """(group.., bands, columns): whether neighbouring bands overlap by half of the shorter, so that they are columns."""
    span = banded.groupBy(*group, "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    w = W.partitionBy(*group).orderBy("band")
    pair = span.withColumn("ptop", F.lag("top").over(w)).withColumn("pbottom", F.lag("bottom").over(w))
    overlap = F.least("bottom", "pbottom") - F.greatest("top", "ptop")
    shorter = F.least(F.col("bottom") - F.col("top"), F.col("pbottom") - F.col("ptop"))
    ok = F.col("ptop").isNull() | (overlap > 0) & (2 * overlap >= shorter)
    return pair.groupBy(*group).agg(F.count("*").alias("bands"), (F.bool_and(ok) & (F.count("*") > 1)).alias("columns"))


def horizontal_cut(atoms: DataFrame, *group: str, floor: int = BLOCK_GUTTER, tie: str = "ord") -> DataFrame:
    """Atoms with part: cut at every gap that equals the widest, if that reaches the floor."""
    w = W.partitionBy(*group).orderBy("y0", "y1", tie)
    edge = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    both = atoms.withColumn("gap", F.col("y0") - edge)
    widest = F.max("gap").over(W.partitionBy(*group))
    both = both.withColumn("opens", F.coalesce((widest >= floor) & (F.col("gap") >= widest), F.lit(False)).cast("int"))
    return both.withColumn("part", F.sum("opens").over(w).cast("bigint")).drop("gap", "opens")


def weighted_median(runs: DataFrame, value: str, weight: str, *group: str) -> DataFrame:
    """(group.., median): the first value at which twice the weight so far goes over all of it."""
    per = runs.groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    seen = F.sum("__w").over(W.partitionBy(*group).orderBy(value))
    total = F.sum("__w").over(W.partitionBy(*group))
    return per.withColumn("__over", 2 * seen > total).where("__over").groupBy(*group).agg(F.min(value).alias("median"))


def furniture(pieces: DataFrame, height: int, *group: str, tie: str = "ord") -> DataFrame:
    """Pieces (box, is_text, body) with furniture: header or footer, where the first or last of several bands is text in the outer tenth."""
    w = W.partitionBy(*group).orderBy("y0", "x0", tie)
    low = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    both = pieces.withColumn("opens", F.coalesce((2 * (F.col("y0") - low) >= F.col("body")).cast("int"), F.lit(0))).withColumn("band", F.sum("opens").over(w))
    per = W.partitionBy(*group, "band")
    both = both.withColumn("text_only", F.bool_and("is_text").over(per)).withColumn("top", F.min("y0").over(per)).withColumn("bottom", F.max("y1").over(per)).withColumn("last", F.max("band").over(W.partitionBy(*group)))
    usable = (F.col("last") > 0) & F.col("text_only") & (F.col("body") > 0)
    head = (F.col("band") == 0) & (MARGIN_ONE_IN * F.col("bottom") <= height)
    foot = (F.col("band") == F.col("last")) & (MARGIN_ONE_IN * (height - F.col("top")) <= height)
    return both.withColumn("furniture", F.when(usable & foot, F.lit("footer")).when(usable & head, F.lit("header"))).drop("opens", "band", "text_only", "top", "bottom", "last")


def em_bin(em: Column) -> Column:
    return F.floor((em + EM_BIN // 2) / EM_BIN).cast("bigint") * EM_BIN


def em_histogram(runs: DataFrame, *group: str) -> DataFrame:
    """(group.., em, chars, bold_chars) over runs with text."""
    body = runs.where(F.length(F.trim("text")) > 0)
    return body.groupBy(*group, em_bin(F.col("em")).alias("em")).agg(F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("bold_chars"))


def line_ems(runs: DataFrame, *line: str) -> DataFrame:
    """(line.., em): the size that most characters of a line have, the smaller of equals."""
    per = em_histogram(runs, *line)
    return per.groupBy(*line).agg(F.max_by("em", F.struct("chars", -F.col("em"))).alias("em"))


def body_em(runs: DataFrame, group: str, *line: str) -> DataFrame:
    """(group, body_em, body_is_bold): the commonest size, or a larger one that is common too."""
    chars = em_histogram(runs, group)
    per = line_ems(runs, group, *line).groupBy(group, "em").agg(F.count("*").alias("n_lines"))
    both = chars.join(per, [group, "em"], "left")
    total = F.sum("chars").over(W.partitionBy(group))
    both = both.withColumn("common", (BODY_SHARE * F.col("chars") >= total) & (F.coalesce("n_lines", F.lit(0)) >= BODY_LINES))
    out = both.groupBy(group).agg(F.max_by("em", F.struct("chars", -F.col("em"))).alias("mode"), F.max(F.when(F.col("common"), F.col("em"))).alias("large"))
    out = out.select(group, F.greatest("mode", F.coalesce("large", "mode")).alias("body_em"))
    return out.join(chars, group).where(F.col("em") == F.col("body_em")).select(group, "body_em", (2 * F.col("bold_chars") > F.col("chars")).alias("body_is_bold"))


def heading_levels(lines_: DataFrame, body: DataFrame, group: str) -> DataFrame:
    """Lines (em, depth, text) with level: the rank of size and depth among headings, six at most; null for others."""
    both = lines_.join(body.select(group, "body_em"), group)
    head = (HEADING_DEN * F.col("em") >= HEADING_NUM * F.col("body_em")) & (F.length(F.trim("text")) > 0)
    heads = both.where(head)
    rank = F.dense_rank().over(W.partitionBy(group).orderBy(em_bin(F.col("em")).desc(), "depth"))
    ranked = heads.withColumn("level", F.least(rank, F.lit(MAX_LEVEL)))
    return ranked.unionByName(both.where(~head).withColumn("level", F.lit(None).cast("int")))


def recurring(lines_: DataFrame, group: str) -> DataFrame:
    """(group, key, n): texts that three lines of a document or more share, in lower case with single spaces."""
    key = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    per = lines_.groupBy(group, key.alias("key")).agg(F.count("*").alias("n"))
    return per.where((F.col("n") >= LABEL_RECURS) & (F.col("key") != ""))


def short_cuts(lines_: DataFrame, *unit: str, order: str = "ord") -> DataFrame:
    """Lines with cut: the one before ends ten heights short of the unit's right edge."""
    edge = F.max("x1").over(W.partitionBy(*unit))
    before = F.lag("x1").over(W.partitionBy(*unit).orderBy(order))
    return lines_.withColumn("cut", F.coalesce(before < edge - SHORT_LINE * (F.col("y1") - F.col("y0")), F.lit(False)))


def page_lead(lines_: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    """(group.., lead): the lower median gap between lines in twentieths of a height, where there are three gaps."""
    w = W.partitionBy(*group).orderBy(order)
    prev = {c: F.lag(c).over(w) for c in ("x0", "x1", "y1")}
    both = lines_.withColumns({f"p{c}": v for c, v in prev.items()}).where(F.col("px0").isNotNull())
    height, gap = F.col("y1") - F.col("y0"), F.col("y0") - F.col("py1")
    overlap = F.least("x1", "px1") - F.greatest("x0", "px0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0"))
    fine = (height > 0) & (2 * overlap >= narrow) & (2 * gap >= -height) & (gap <= 3 * height)
    gaps = both.where(fine).withColumn("g", F.expr("20 * (y0 - py1) div (y1 - y0)"))
    per = gaps.groupBy(*group).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    return per.where(F.size("gs") >= 3).select(*group, F.element_at("gs", F.expr("(size(gs) - 1) div 2 + 1").cast("int")).alias("lead"))


def hard_breaks(lines_: DataFrame, *unit: str, order: str = "ord") -> DataFrame:
    """Lines with brk: the line before ends so early that this one's first word, with room, would have fitted."""
    w = W.partitionBy(*unit).orderBy(order)
    edge = F.max("x1").over(W.partitionBy(*unit))
    chars = F.greatest(F.length(F.trim("text")), F.lit(1))
    word = F.length(F.regexp_extract(F.trim("text"), r"^(\S*)", 1)) * F.floor((F.col("x1") - F.col("x0")) / chars).cast("bigint")
    mid = F.lag(F.expr("(y0 + y1) div 2")).over(w)
    return lines_.withColumn("brk", F.coalesce((F.col("y0") > mid) & (F.lag("x1").over(w) + 2 * word <= edge), F.lit(False)))


def indent_cuts(lines_: DataFrame, *unit: str, order: str = "ord") -> DataFrame:
    """Lines with cut: indented by half a height, while the next one returns to within a quarter of the start before."""
    w = W.partitionBy(*unit).orderBy(order)
    h = F.col("y1") - F.col("y0")
    before, after = F.lag("x0").over(w), F.lead("x0").over(w)
    return lines_.withColumn("cut", F.coalesce((2 * (F.col("x0") - before) >= h) & (4 * F.abs(after - before) <= h), F.lit(False)))


def cells_of_lines(words: DataFrame, *line: str, em: int = 1000, order: str = "w") -> DataFrame:
    """Words with cell: a new one opens where the gap goes over an em."""
    w = W.partitionBy(*line).orderBy("x0", order)
    opens = F.coalesce((F.col("x0") - F.lag("x1").over(w) > em).cast("int"), F.lit(0))
    return words.withColumn("__o", opens).withColumn("cell", F.sum("__o").over(w).cast("bigint")).drop("__o")


def ink_joins(words: DataFrame, *line: str, epsilon: int = 12, word_gap: int = 400, order: str = "w") -> DataFrame:
    """Words with joins: the gap to the one before is at most ``epsilon`` or under the word gap."""
    w = W.partitionBy(*line).orderBy("x0", order)
    gap = F.col("x0") - F.lag("x1").over(w)
    return words.withColumn("joins", F.coalesce((gap <= epsilon) | (gap < word_gap), F.lit(False)))


def pitch(words: DataFrame, *font: str) -> DataFrame:
    """(font.., pitch, n): the upper median of advance by character, where there are two samples."""
    per = words.where(F.length("text") > 0).groupBy(*font).agg(F.array_sort(F.collect_list(F.expr("(x1 - x0) div length(text)"))).alias("p"))
    return per.where(F.size("p") >= 2).select(*font, F.element_at("p", F.expr("size(p) div 2 + 1").cast("int")).alias("pitch"), F.size("p").cast("bigint").alias("n"))
