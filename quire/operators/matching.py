"""Matching runs, labels, bars, tracks and boxes: ranges, nearest neighbours and unique matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values of the rules.
TRACK_TOLERANCE = 600
PANEL_CHARS = 120


def is_rtl(t: Column) -> Column:
    """Whether a text has a character of a right-to-left script."""
    return t.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")


def is_track_number(t: Column) -> Column:
    """A digit, and nothing but digits, spaces, number marks and currency signs."""
    return t.rlike(r"^[0-9\s.,%()+\-−–$€£¥]*$") & t.rlike("[0-9]")


def is_contents(cells: DataFrame, *column: str, order: str) -> DataFrame:
    """(column.., contents): three cells or more, page numbers of four digits at most that never fall, or Roman numerals."""
    t = F.trim("text")
    num = t.rlike("^[0-9]{1,4}$")
    page = F.when(num, t.cast("int"))
    high = F.max(page).over(W.partitionBy(*column).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ok = num & (page >= F.coalesce(high, F.lit(0))) | ~num & t.rlike("^[ivxlcdmIVXLCDM]+$")
    return cells.withColumn("__ok", ok).groupBy(*column).agg((F.bool_and("__ok") & (F.count("*") >= 3)).alias("contents"))


def ink_box(x: Column, y: Column, advance: Column, ascent: Column, descent: Column) -> Column:
    """The box of a run's advance between its font's ascent and descent, or why there is none."""
    empty = F.lit(None).cast("bigint")
    why = F.when(ascent.isNull() | descent.isNull(), F.lit("no-metrics")).when(advance.isNull() | (advance == 0), F.lit("no-ink-to-measure")).when(ascent <= descent, F.lit("invalid"))
    val = lambda v: F.when(why.isNull(), v.cast("bigint")).otherwise(empty)
    return F.struct(val(F.least(x, x + advance)).alias("x0"), val(y - ascent).alias("y0"), val(F.greatest(x, x + advance)).alias("x1"), val(y - descent).alias("y1"), why.alias("absence"))


def findings(runs: DataFrame, width: int, height: int) -> DataFrame:
    """Runs with findings: off-page-text beyond the visible box, invisible-render-mode-text in mode 3; none is removed."""
    off = (F.col("x1") <= 0) | (F.col("x0") >= width) | (F.col("y1") <= 0) | (F.col("y0") >= height)
    return runs.withColumn("findings", F.array_compact(F.array(F.when(off, F.lit("off-page-text")), F.when(F.col("mode") == 3, F.lit("invisible-render-mode-text")))))


def text_inside(regions: DataFrame, runs: DataFrame, key: str = "page") -> DataFrame:
    """(key, id, chars): characters other than spaces of the runs whose origin lies in a region, edges included."""
    r = runs.select(key, F.col("x0").alias("rx"), F.col("y0").alias("ry"), F.length(F.regexp_replace("text", r"\s", "")).alias("n"))
    inside = (F.col("rx") >= F.col("x0")) & (F.col("rx") <= F.col("x1")) & (F.col("ry") >= F.col("y0")) & (F.col("ry") <= F.col("y1"))
    return regions.join(r, key, "left").groupBy(key, "id").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("chars"))


def panels(regions: DataFrame, runs: DataFrame, area: int, key: str = "page") -> DataFrame:
    """Regions with kept: not four fifths of the page, and not a panel that holds much text."""
    held = text_inside(regions, runs, key)
    both = regions.join(held, [key, "id"])
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return both.withColumn("kept", (size * 10 < F.lit(area) * 8) & (F.col("chars") < PANEL_CHARS))


def only_match(bars: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, bar, label): the one label whose centre lies on a bar that is the only one there; others match nothing."""
    cx, cy = F.expr("(lx0 + lx1) div 2"), F.expr("(ly0 + ly1) div 2")
    on = (cx >= F.col("x0")) & (cx < F.col("x1")) & (cy >= F.col("y0")) & (cy < F.col("y1"))
    pair = bars.select(key, F.col("id").alias("bar"), "x0", "y0", "x1", "y1").join(labels.select(key, F.col("id").alias("label"), *(F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1"))), key).where(on & (F.col("bar") != F.col("label")))
    one = F.count("*").over(W.partitionBy(key, "bar"))
    other = F.count("*").over(W.partitionBy(key, "label"))
    return pair.withColumn("n", one).withColumn("m", other).where("n = 1 and m = 1").select(key, "bar", "label")


def nearest_below(bars: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, bar, label, distance): the nearest label under each bar, by its top and then its id."""
    pair = bars.select(key, F.col("id").alias("bar"), "x0", "x1", "y1").join(labels.select(key, F.col("id").alias("label"), F.expr("(x0 + x1) div 2").alias("cx"), F.col("y0").alias("top")), key)
    pair = pair.where((F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("top") >= F.col("y1")) & (F.col("bar") != F.col("label"))).withColumn("distance", F.col("top") - F.col("y1"))
    rank = F.row_number().over(W.partitionBy(key, "bar").orderBy("distance", "label"))
    return pair.withColumn("r", rank).where("r = 1").select(key, "bar", "label", "distance")


def track_of(cells: DataFrame, tracks: DataFrame, key: str, tolerance: int = TRACK_TOLERANCE) -> DataFrame:
    """Cells with track: the nearest by centre, else by left edge, else by right edge, each within the tolerance; null for none."""
    t = tracks.select(key, F.col("id").alias("k"), F.col("x0").alias("t0"), F.col("x1").alias("t1"))
    dist = (F.abs(F.expr("(x0 + x1) div 2") - F.expr("(t0 + t1) div 2")), F.abs(F.col("x0") - F.col("t0")), F.abs(F.col("x1") - F.col("t1")))
    tier = F.when(dist[0] <= tolerance, F.struct(F.lit(0).alias("tier"), dist[0].alias("d"), F.col("k"))).when(dist[1] <= tolerance, F.struct(F.lit(1).alias("tier"), dist[1].alias("d"), F.col("k"))).when(dist[2] <= tolerance, F.struct(F.lit(2).alias("tier"), dist[2].alias("d"), F.col("k")))
    return cells.join(t, key).groupBy(key, "id").agg(F.min(tier).alias("b")).select(key, "id", F.col("b.k").alias("track"))


def row_fits(placed: DataFrame, key: str) -> DataFrame:
    """(key, fits): at most one cell off the tracks, and no two on one."""
    return placed.groupBy(key).agg(((F.count_if(F.col("track").isNull()) <= 1) & (F.countDistinct("track") == F.count("track"))).alias("fits"))


def clear_of_neighbours(cells: DataFrame, *line: str, order: str) -> DataFrame:
    """Cells with clear: they start after the one before ends, and end before the next starts."""
    w = W.partitionBy(*line).orderBy("x0", order)
    return cells.withColumn("clear", F.coalesce(F.lag("x1").over(w) < F.col("x0"), F.lit(True)) & F.coalesce(F.lead("x0").over(w) > F.col("x1"), F.lit(True)))


def unclaimed(runs: DataFrame, claims: DataFrame, *key: str) -> DataFrame:
    """Runs that no table holds."""
    return runs.join(claims.select(*key).distinct(), list(key), "left_anti")


def source_binding(sources: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, binding): matched, mismatched, or not_checked where no digest is declared."""
    both = sources.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")).join(declared.select(key, "digest"), key, "left")
    return both.select(key, F.when(F.col("digest").isNull(), "not_checked").when(F.col("digest") == F.col("own"), "matched").otherwise("mismatched").alias("binding"))


def elements_omitted(elements: DataFrame, ceiling: int, *group: str) -> DataFrame:
    """(group.., kept, omitted): texts over the ceiling in bytes are left out and counted."""
    over = F.octet_length("text") > ceiling
    return elements.groupBy(*group).agg(F.count_if(~over).alias("kept"), F.count_if(over).alias("omitted"))


def unit_continues(lines: DataFrame, *group: str, order: str) -> DataFrame:
    """Lines with continues: in the unit of the line before, both headings of one level or both bold body."""
    w = W.partitionBy(*group).orderBy(order)
    same = F.lag("unit").over(w) == F.col("unit")
    level = F.lag("level").over(w) == F.col("level")
    body = F.lag("level").over(w).isNull() & F.col("level").isNull() & F.lag("bold").over(w) & F.col("bold")
    return lines.withColumn("continues", F.coalesce(same & (F.coalesce(level, F.lit(False)) | body), F.lit(False)))
