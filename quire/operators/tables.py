"""Tables as relations: slots, faults, lattices, cross-checks, plans, rows of HTML, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions import strings as S
from quire.operators import layout

# Fixed values of the rules.
MAX_FACES = 4096
UNRULED_COLUMN_GUTTER, UNRULED_ROW_GUTTER = 1200, 600


def slots(cells: DataFrame) -> DataFrame:
    """Cells with a row for every slot (sr, sc) that their spans reach."""
    rows = F.explode(F.sequence(F.col("r"), F.col("r") + F.greatest("rowspan", F.lit(1)) - 1))
    return cells.withColumn("sr", rows).withColumn("sc", F.explode(F.sequence(F.col("c"), F.col("c") + F.greatest("colspan", F.lit(1)) - 1)))


def cover(cells: DataFrame) -> DataFrame:
    """(tbl, sr, sc, owners)."""
    return slots(cells).groupBy("tbl", "sr", "sc").agg(F.count("*").alias("owners"))


def faults(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(tbl, sr, sc, fault): unowned, owned-more-than-once and outside-grid slots; grids: (tbl, n_rows, n_cols)."""
    own = cover(cells)
    from_0 = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    grid = grids.select("tbl", from_0("n_rows").alias("sr"), "n_cols").select("tbl", "sr", from_0("n_cols").alias("sc"), F.lit(True).alias("inside"))
    both = own.join(grid, ["tbl", "sr", "sc"], "full_outer")
    fault = F.when(F.col("inside").isNull(), "outside-grid").when(F.col("owners").isNull(), "unowned").when(F.col("owners") > 1, "owned-more-than-once")
    return both.select("tbl", "sr", "sc", fault.alias("fault")).where("fault is not null")


def plan(cells: DataFrame, grids: DataFrame, order: str = "cell") -> DataFrame:
    """Cells with placed: inside the grid, and the first on their slot; the others print nowhere and are counted."""
    both = cells.join(grids, "tbl")
    inside = (F.col("r") < F.col("n_rows")) & (F.col("c") < F.col("n_cols"))
    rank = F.row_number().over(W.partitionBy("tbl", "r", "c").orderBy(order))
    return both.withColumn("placed", inside & (rank == 1))


def erasures(planned: DataFrame) -> DataFrame:
    """(tbl, not_placed, span_slots): what the plan can't show, counted."""
    span = F.when(F.col("placed"), F.col("rowspan") * F.col("colspan") - 1).otherwise(0)
    return planned.groupBy("tbl").agg(F.count_if(~F.col("placed")).alias("not_placed"), F.sum(span).alias("span_slots"))


def clamp(planned: DataFrame) -> DataFrame:
    """Placed cells with fit_rows and fit_cols: spans that stop at the grid's edge and before another cell's origin.

    Columns shrink first, until no origin lies in the reached slots of any row;
    rows shrink next, over the columns that are left.
    """
    p = planned.where("placed")
    origin = p.select("tbl", F.col("r").alias("orow"), F.col("c").alias("ocol"))
    reach = p.withColumn("fr", F.least("rowspan", F.col("n_rows") - F.col("r"))).withColumn("fc", F.least("colspan", F.col("n_cols") - F.col("c")))
    wide = reach.where((F.col("fr") > 1) | (F.col("fc") > 1))
    grid = wide.select("tbl", "cell", "r", "c", "fr", "fc", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("fr") - 1)).alias("orow")).withColumn("ocol", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("fc") - 1)))
    hit = grid.where((F.col("orow") != F.col("r")) | (F.col("ocol") != F.col("c"))).join(origin, ["tbl", "orow", "ocol"])
    # The last column is dropped while it meets an origin: what remains ends before the last run of met columns.
    cols = hit.where(F.col("ocol") > F.col("c")).groupBy("tbl", "cell").agg(F.collect_set("ocol").alias("met_cols"))
    all_hits = hit.groupBy("tbl", "cell").agg(F.collect_set(F.struct("orow", "ocol")).alias("met"))
    both = reach.join(cols, ["tbl", "cell"], "left").join(all_hits, ["tbl", "cell"], "left")

    def shrink(count: Column, start: Column, met: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda k: (k == 0) | ~F.array_contains(met, start + k))
        return F.array_max(free) + 1

    none = F.array().cast("array<bigint>")
    both = both.withColumn("fit_cols", shrink(F.col("fc"), F.col("c"), F.coalesce("met_cols", none)))
    left = F.transform(F.filter(F.coalesce("met", F.array().cast("array<struct<orow:bigint,ocol:bigint>>")), lambda m: (m["orow"] > F.col("r")) & (m["ocol"] < F.col("c") + F.col("fit_cols"))), lambda m: m["orow"])
    return both.withColumn("fit_rows", shrink(F.col("fr"), F.col("r"), left)).drop("met", "met_cols", "fr", "fc")


def html_rows(clamped: DataFrame) -> DataFrame:
    """(tbl, r, html): each row's origin cells in order, with their spans; covered slots are skipped."""
    attr = lambda n, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    td = F.concat(F.lit("<td"), attr("rowspan", "fit_rows"), attr("colspan", "fit_cols"), F.lit(">"), S.html_escape(S.normalize(F.col("text"))), F.lit("</td>"))
    per = clamped.groupBy("tbl", "r").agg(F.array_sort(F.collect_list(F.struct("c", td.alias("td")))).alias("tds"))
    return per.select("tbl", "r", F.concat(F.lit("<tr>"), F.array_join(F.col("tds.td"), ""), F.lit("</tr>")).alias("html"))


def header_rows(clamped: DataFrame) -> DataFrame:
    """(tbl, header): 2 where every spanning cell of the first row is divided by the second, 0 elsewhere."""
    first = clamped.where((F.col("r") == 0) & (F.col("fit_cols") > 1)).select("tbl", F.col("c").alias("start"), F.col("fit_cols").alias("span"))
    second = clamped.where("r = 1").select("tbl", "c", "fit_rows", "fit_cols")
    kids = first.join(second, (first["tbl"] == second["tbl"]) & (second["c"] >= first["start"]) & (second["c"] < first["start"] + first["span"]), "left").groupBy(first["tbl"].alias("tbl"), "start", "span").agg(F.count("c").alias("n"), F.bool_and((F.col("fit_rows") == 1) & (F.col("c") + F.col("fit_cols") <= F.col("start") + F.col("span"))).alias("fine"))
    divided = kids.groupBy("tbl").agg(F.bool_and((F.col("n") >= 2) & F.coalesce("fine", F.lit(False))).alias("all"))
    grids = clamped.groupBy("tbl").agg(F.max("n_rows").alias("n_rows"))
    return grids.join(divided, "tbl", "left").select("tbl", F.when((F.col("n_rows") > 2) & F.col("all"), 2).otherwise(0).alias("header"))


def unruled(runs: DataFrame, *group: str, order: str = "ord") -> DataFrame:
    """(group.., n_rows, n_cols, refusal): whether the origins of a group are a table without rules.

    Tests in order: at least 2x2 (else no candidate), not too many faces,
    gutters, every face filled, emitted row by row.
    """
    per = runs.groupBy(*group).agg(layout.fold(F.collect_set("x0")).alias("xs"), layout.fold(F.collect_set("y0")).alias("ys"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "x0", "y0"))).alias("rs"))
    line = lambda lines, v: F.greatest(F.size(F.filter(lines, lambda x: x <= v)) - 1, F.lit(0))
    face = F.transform("rs", lambda p: line(F.col("ys"), p["y0"]) * F.size("xs") + line(F.col("xs"), p["x0"]))
    per = per.withColumn("faces", face)
    gaps = lambda xs: F.array_min(F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs), F.lit(2))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(1))), lambda b, a: b - a))
    rising = F.aggregate("faces", F.struct(F.lit(0).alias("high"), F.lit(True).alias("ok")), lambda a, f: F.struct(F.greatest(a["high"], f).alias("high"), (a["ok"] & (f >= a["high"])).alias("ok")), lambda a: a["ok"])
    rows, cols = F.size("ys"), F.size("xs")
    refusal = (
        F.when((rows < 2) | (cols < 2), F.lit("none"))
        .when(rows * cols > MAX_FACES, F.lit("too-many-faces"))
        .when(gaps(F.col("xs")) < UNRULED_COLUMN_GUTTER, F.lit("column-gutter"))
        .when(gaps(F.col("ys")) < UNRULED_ROW_GUTTER, F.lit("row-gutter"))
        .when(F.size(F.array_distinct("faces")) < rows * cols, F.lit("empty-face"))
        .when(~rising, F.lit("emission-order"))
    )
    return per.select(*group, rows.cast("bigint").alias("n_rows"), cols.cast("bigint").alias("n_cols"), refusal.alias("refusal"))


def cross_check(boxes: DataFrame, table: DataFrame, key: str = "page", item: str = "id") -> DataFrame:
    """(key, outside, overlaps, tiles): cells beyond the table's box, pairs that overlap, and whether areas add up.

    Pairs are looked for within one table and from left to right only.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    t = table.select(key, *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    out = ~((F.col("x0") >= F.col("tx0")) & (F.col("y0") >= F.col("ty0")) & (F.col("x1") <= F.col("tx1")) & (F.col("y1") <= F.col("ty1")))
    single = boxes.join(t, key).groupBy(key).agg(F.count_if(out).alias("outside"), (F.sum(area) == F.max((F.col("tx1") - F.col("tx0")) * (F.col("ty1") - F.col("ty0")))).alias("tiles"))
    a, b = (boxes.select(key, *(F.col(c).alias(f"{s}_{c}") for c in (item, "x0", "y0", "x1", "y1"))) for s in "ab")
    hit = (F.struct("a_x0", f"a_{item}") < F.struct("b_x0", f"b_{item}")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    pairs = a.join(b, key).where(hit).groupBy(key).agg(F.count("*").alias("overlaps"))
    return single.join(pairs, key, "left").select(key, "outside", F.coalesce("overlaps", F.lit(0)).alias("overlaps"), "tiles")


def cell_f1(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """(tbl, tp, fp, fn, f1): slots by place and normalised text, F1 in thousandths; null where nothing is to be found."""
    key = ["tbl", "sr", "sc", "t"]
    slot = lambda x, n: slots(x).select("tbl", "sr", "sc", S.normalize(F.col("text")).alias("t")).distinct().withColumn(n, F.lit(1))
    both = slot(detected, "d").join(slot(gold, "g"), key, "full_outer")
    per = both.groupBy("tbl").agg(F.count_if(F.col("d").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("d").isNull()).alias("fn"))
    return per.withColumn("f1", F.expr("case when 2 * tp + fp + fn = 0 then null else 2000 * tp div (2 * tp + fp + fn) end"))


def runs_inside(runs: DataFrame, regions: DataFrame, key: str = "page") -> DataFrame:
    """(key, region, n, ids): the items whose origin lies in a region, half open."""
    r = regions.select(key, F.col("id").alias("region"), *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("x0") >= F.col("rx0")) & (F.col("x0") < F.col("rx1")) & (F.col("y0") >= F.col("ry0")) & (F.col("y0") < F.col("ry1"))
    return runs.join(r, key).where(inside).groupBy(key, "region").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


def first_region(runs: DataFrame, regions: DataFrame, key: str = "page") -> DataFrame:
    """(key, id, region): the first region, by its id, that holds the origin of each item; null for none."""
    r = regions.select(key, F.col("id").alias("region"), *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("x0") >= F.col("rx0")) & (F.col("x0") < F.col("rx1")) & (F.col("y0") >= F.col("ry0")) & (F.col("y0") < F.col("ry1"))
    return runs.join(r, key).groupBy(key, "id").agg(F.min(F.when(inside, F.col("region"))).alias("region"))


def overlapped_by_half(figures: DataFrame, tables: DataFrame, key: str = "page") -> DataFrame:
    """Figures that a table overlaps by half of their area or more."""
    t = tables.select(F.col(key).alias("tkey"), F.col("id").alias("tid"), *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    w = F.greatest(F.least("x1", "tx1") - F.greatest("x0", "tx0"), F.lit(0))
    h = F.greatest(F.least("y1", "ty1") - F.greatest("y0", "ty0"), F.lit(0))
    half = 2 * w * h >= (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return figures.join(t, (F.col(key) == F.col("tkey")) & (F.col("id") != F.col("tid")) & half, "left_semi")


def expand_repeats(cells: DataFrame, *group: str, order: str, repeat: str = "repeat", cap: int = 4096) -> DataFrame:
    """Cells with a row for each repetition and col, its running column from 0; repeats over the cap count as the cap."""
    n = F.least(F.greatest(F.col(repeat), F.lit(1)), F.lit(cap))
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n).over(w), F.lit(0))
    return cells.withColumn("__start", start).withColumn("__k", F.explode(F.sequence(F.lit(0), n.cast("int") - 1))).withColumn("col", (F.col("__start") + F.col("__k")).cast("bigint")).drop("__start", "__k")


def in_order(bars: DataFrame, *chart: str) -> DataFrame:
    """(chart.., agrees): no bar a tenth longer than another has a smaller number, none a third longer one that isn't larger."""
    p = bars.where("length > 0 and value > 0")
    a = p.select(*chart, F.col("length").alias("l1"), F.col("value").alias("v1"))
    b = p.select(*chart, F.col("length").alias("l2"), F.col("value").alias("v2"))
    bad = (10 * F.col("l1") < 9 * F.col("l2")) & (F.col("v1") > F.col("v2")) | (4 * F.col("l1") < 3 * F.col("l2")) & (F.col("v1") >= F.col("v2"))
    broken = a.join(b, list(chart)).where(bad).select(*chart).distinct().withColumn("bad", F.lit(True))
    counts = p.groupBy(*chart).agg(F.count("*").alias("n"))
    return counts.join(broken, list(chart), "left").select(*chart, ((F.col("n") >= 2) & F.col("bad").isNull()).alias("agrees"))
