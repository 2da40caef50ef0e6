"""Charts, drawn tables, tagged tables and headings: equi-joins on the page, then geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import layout as L

# Fixed values of the rules.
COLOUR_NEAR = 0.005
TITLE_HEIGHTS = 4
MAX_FACES = 4096
NUMBER_GAP_HEIGHTS = 3
SECTION = r"^[0-9]+(\.[0-9]+)*\.?$"


def is_white(colour: Column) -> Column:
    """Whether a colour of one (grey), three (red, green, blue) or four (inks) numbers is white."""
    ink = F.size(colour) == 4
    return F.size(colour).isin(1, 3, 4) & F.forall(colour, lambda c: c == F.when(ink, F.lit(0.0)).otherwise(F.lit(1.0)))


def same_colour(a: Column, b: Column, near: float = COLOUR_NEAR) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= near), lambda ok: ok)


def legend(swatches: DataFrame, labels: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """(key, series, label): the label beside the only swatch of a series' colour, where it is the only one there.

    swatches: (key, swatch, x0, y0, x1, y1, colour); labels: (key, label, x0, y0, x1, y1); series: (key, series, colour).
    Beside: to the right, no farther than the swatch is wide, with a vertical overlap.
    """
    s = swatches.select(key, "swatch", *(F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")), F.col("colour").alias("paint"))
    beside = (F.col("x0") >= F.col("sx1")) & (F.col("x0") - F.col("sx1") <= F.col("sx1") - F.col("sx0")) & (F.col("y0") < F.col("sy1")) & (F.col("sy0") < F.col("y1"))
    told = s.join(labels, key).where(beside).groupBy(key, "swatch").agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n = 1").drop("n")
    own = series.join(s, key).where(same_colour(F.col("colour"), F.col("paint"))).groupBy(key, "series").agg(F.min("swatch").alias("swatch"), F.count("*").alias("n")).where("n = 1").drop("n")
    return own.join(told, [key, "swatch"]).select(key, "series", "label")


def slice_labels(slices: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, slice, label) of labels whose direction from the centre lies in just one slice that has just that label.

    slices: (key, slice, cx, cy, from, to) in degrees, from < to; labels: (key, label, x, y).
    """
    turn = F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    angle = F.when(turn < 0, turn + 360).otherwise(turn)
    both = slices.join(labels, key).where((angle >= F.col("from")) & (angle < F.col("to"))).select(key, "slice", "label")
    one = lambda c: F.count("*").over(W.partitionBy(key, c)) == 1
    return both.withColumn("ok", one("slice") & one("label")).where("ok").drop("ok")


def small_multiples(categories: DataFrame, chart: str, label: str) -> DataFrame:
    """(signature, first, charts): charts with the same category labels become one table."""
    per = categories.groupBy(chart).agg(F.array_join(F.array_sort(F.collect_set(label)), "|").alias("signature"))
    return per.groupBy("signature").agg(F.min(chart).alias("first"), F.count("*").alias("charts"))


def chart_title(charts: DataFrame, labels: DataFrame, *key: str) -> DataFrame:
    """(key.., label): the lowest label above a chart, within TITLE_HEIGHTS of its height, that is alone on its line,

    doesn't end in a full stop and has no other label within half its height above. charts: (key.., top, left, right).
    """
    height = F.col("y1") - F.col("y0")
    line = W.partitionBy(*key).orderBy("y0", "y1", "label")
    alone = (F.coalesce(F.lag("y1").over(line), F.lit(-(1 << 40))) <= F.col("y0")) & (F.coalesce(F.lead("y0").over(line), F.lit(1 << 40)) >= F.col("y1"))
    clear = F.col("y0") - F.coalesce(F.lag("y1").over(line), F.lit(-(1 << 40))) > height / 2
    above = labels.withColumn("alone", alone & clear).join(charts, list(key)).where((F.col("y1") <= F.col("top")) & (F.col("top") - F.col("y1") <= TITLE_HEIGHTS * height) & (F.col("x0") < F.col("right")) & (F.col("left") < F.col("x1")))
    lowest = above.groupBy(*key).agg(F.max_by(F.struct("label", "alone", "text"), F.struct("y1", "label")).alias("b"))
    return lowest.where(F.col("b.alone") & ~F.col("b.text").endswith(".")).select(*key, F.col("b.label").alias("label"))


def ruled(boxes: DataFrame, *key: str) -> DataFrame:
    """(key.., n_rows, n_cols, refusal): whether drawn boxes are the cells of a table.

    Their edges are folded into lines; neighbouring lines bound faces. At least
    two faces, at most MAX_FACES, each covered, and by one box only.
    """
    both = lambda a, b: L.fold(F.array_union(F.collect_set(a), F.collect_set(b)))
    per = boxes.groupBy(*key).agg(both("x0", "x1").alias("xs"), both("y0", "y1").alias("ys"), F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("bs"))
    line = lambda lines, v: F.size(F.filter(lines, lambda x: x <= v)) - 1
    at = F.transform("bs", lambda b: F.struct(line(F.col("xs"), b["x0"]).alias("a"), line(F.col("xs"), b["x1"]).alias("b"), line(F.col("ys"), b["y0"]).alias("c"), line(F.col("ys"), b["y1"]).alias("d")))
    rows, cols = F.size("ys") - 1, F.size("xs") - 1
    per = per.withColumn("at", at).withColumn("faces", rows.cast("bigint") * cols)
    small = per.where(F.col("faces") <= MAX_FACES)
    owned = small.select(*key, F.explode("at").alias("p")).where("p.b > p.a and p.d > p.c")
    owned = owned.select(*key, F.explode(F.sequence(F.col("p.a"), F.col("p.b") - 1)).alias("i"), "p").select(*key, "i", F.explode(F.sequence(F.col("p.c"), F.col("p.d") - 1)).alias("j"))
    owned = owned.groupBy(*key, "i", "j").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("covered"), F.max("n").alias("most"))
    refusal = F.when(F.col("faces") < 2, "none").when(F.col("faces") > MAX_FACES, "too-many-faces").when(F.coalesce("covered", F.lit(0)) < F.col("faces"), "uncovered-face").when(F.col("most") > 1, "overlap")
    return per.join(owned, list(key), "left").select(*key, rows.cast("bigint").alias("n_rows"), cols.cast("bigint").alias("n_cols"), refusal.alias("refusal"))


def tagged_grid(cells: DataFrame, table: str = "tbl", row: str = "r", order: str = "c", item: str = "cell") -> DataFrame:
    """cells with ``column``: where a tagged cell begins, by the spans of those before it in its row."""
    before = W.partitionBy(table, row).orderBy(order, item).rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("column", F.coalesce(F.sum("colspan").over(before), F.lit(0)))


def tagged_difference(tagged: DataFrame, drawn: DataFrame) -> DataFrame:
    """(tbl, sr, sc, side) of slots (tbl, sr, sc) that only one of the two has. Nothing is repaired."""
    a, b = (x.select("tbl", "sr", "sc").distinct().withColumn(n, F.lit(True)) for x, n in ((tagged, "t"), (drawn, "d")))
    both = a.join(b, ["tbl", "sr", "sc"], "full_outer").where("t is null or d is null")
    return both.select("tbl", "sr", "sc", F.when(F.col("t").isNull(), "drawn").otherwise("tagged").alias("side"))


def numbered_headings(pieces: DataFrame, *line: str, order: str) -> DataFrame:
    """pieces with ``continues``: whether it follows a section number on its line, at most three heights away."""
    w = W.partitionBy(*line).orderBy(order)
    gap = F.col("x0") - F.lag("x1").over(w)
    number = F.lag("text").over(w).rlike(SECTION) & (F.row_number().over(w) == 2)
    return pieces.withColumn("continues", F.coalesce(number & (gap >= 0) & (gap <= NUMBER_GAP_HEIGHTS * F.col("height")) & ~F.col("text").rlike(SECTION), F.lit(False)))


def seal(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, rule, n): invariants of a representation that its nodes (doc, id, parent, ordinal, page) break, and how often.

    Ids differ; parents are there; ordinals are 1.. without a gap; pages count from 1 and don't go back.
    """
    w = W.partitionBy(doc).orderBy("ordinal", "id")
    ids = nodes.groupBy(doc, "id").agg(F.count("*").alias("k"))
    twice = ids.where("k > 1").select(doc, F.lit("id-twice").alias("rule"))
    lost = nodes.where(F.col("parent").isNotNull()).select(doc, F.col("parent").alias("id")).join(ids.select(doc, "id"), [doc, "id"], "left_anti").select(doc, F.lit("parent-missing").alias("rule"))
    gaps = nodes.select(doc, F.col("ordinal"), F.row_number().over(w).alias("n")).where("ordinal <> n").select(doc, F.lit("ordinal-gap").alias("rule"))
    low = nodes.where("page < 1").select(doc, F.lit("page-range").alias("rule"))
    back = nodes.select(doc, "page", F.lag("page").over(w).alias("before")).where("page < before").select(doc, F.lit("page-order").alias("rule"))
    return twice.unionByName(lost).unionByName(gaps).unionByName(low).unionByName(back).groupBy(doc, "rule").agg(F.count("*").alias("n"))
