"""What was read and what wasn't: tallies, reasons, page states, coverage, limitations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Thresholds of the classifier, fixed values.
SPARSE_TEXT_BYTES = 20
VECTOR_TEXT_PATHS = 200
DENSE_GRAPHICS_PATHS = 500
TABLE_RECTANGLES = 12


def tally(facts: DataFrame) -> DataFrame:
    """(doc, page, counts) from (doc, page, op, text_bytes, rectangle)."""
    is_ = lambda op: F.col("op") == op
    return facts.groupBy("doc", "page").agg(
        F.count_if(is_("text")).alias("text_operators"),
        F.sum(F.when(is_("text"), F.col("text_bytes")).otherwise(0)).alias("text_bytes"),
        F.count_if(is_("image")).alias("image_count"),
        F.count_if(is_("path")).alias("path_operators"),
        F.count_if(is_("path") & F.col("rectangle")).alias("rectangles"),
        F.count_if(is_("annotation")).alias("annotations"),
    )


def reasons(tallies: DataFrame, vector: int = VECTOR_TEXT_PATHS, dense: int = DENSE_GRAPHICS_PATHS, tables: int = TABLE_RECTANGLES) -> DataFrame:
    """Tallies with the sorted reason codes that apply to each page."""
    no_text, images = F.col("text_operators") == 0, F.col("image_count") > 0
    code = lambda when, name: F.when(when, F.lit(name))
    codes = F.array(
        code(no_text, "no-text"),
        code(no_text & images, "scanned"),
        code(no_text & (F.col("path_operators") >= vector), "vector-text"),
        code(~no_text & (F.col("text_bytes") < SPARSE_TEXT_BYTES) & images, "sparse-text"),
        code(images, "embedded-images"),
        code(F.col("annotations") > 0, "annotation-text"),
        code(F.col("rectangles") >= tables, "table-likely"),
        code(F.col("path_operators") >= dense, "dense-graphics"),
    )
    return tallies.withColumn("reasons", F.array_sort(F.array_compact(codes)))


def document_reasons(pages: DataFrame) -> DataFrame:
    """(doc, reasons, needs_attention): the sorted distinct union over pages."""
    per = pages.select("doc", F.explode_outer("reasons").alias("code")).groupBy("doc").agg(F.array_sort(F.collect_set("code")).alias("reasons"))
    return per.withColumn("needs_attention", F.size("reasons") > 0)


def admit(pages: DataFrame, budget: int) -> DataFrame:
    """Pages with state and code: over the budget they are quarantined and declared, never dropped."""
    over = F.col("page") > budget
    return pages.withColumn("state", F.when(over, "quarantined").otherwise("processed")).withColumn("code", F.when(over, F.lit("resource-limit-pages")))


def sample(pages: DataFrame, n: int) -> DataFrame:
    """The first n pages of each document."""
    return pages.withColumn("__n", F.row_number().over(W.partitionBy("doc").orderBy("page"))).where(F.col("__n") <= n).drop("__n")


STATES = ("processed", "failed", "unsupported", "quarantined", "not_attempted")


def coverage(states: DataFrame) -> DataFrame:
    """(doc, authorized, one count for each state, reconciles)."""
    per = states.groupBy("doc").agg(F.countDistinct("page").alias("authorized"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    total = sum((F.col(s) for s in STATES), F.lit(0))
    return per.withColumn("reconciles", total == F.col("authorized"))


def terminal_state(states: DataFrame) -> DataFrame:
    """(doc, terminal, pages_not_processed, first_gap_page)."""
    gap = F.col("state") != "processed"
    per = states.groupBy("doc").agg(F.count_if(gap).alias("pages_not_processed"), F.min(F.when(gap, F.col("page"))).alias("first_gap_page"))
    return per.withColumn("terminal", F.when(F.col("pages_not_processed") == 0, "complete").otherwise("partial"))


def normalize_limitations(limitations: DataFrame) -> DataFrame:
    """Distinct rows; their order is that of the columns."""
    return limitations.distinct()


def undeclared_gaps(states: DataFrame, limitations: DataFrame) -> DataFrame:
    """States whose code no limitation of the document declares: empty in a sound record."""
    return states.where("code is not null").join(limitations.select("doc", "code").distinct(), ["doc", "code"], "left_anti")


def page_binding(asked: DataFrame, states: DataFrame, limitations: DataFrame) -> DataFrame:
    """(doc, page, status): ok, a state that isn't processed, capability-limited, or out-of-range."""
    scoped = limitations.where("page is not null").groupBy("doc", "page").agg(F.min("code").alias("limit_code"))
    both = asked.join(states.select("doc", "page", "state"), ["doc", "page"], "left").join(scoped, ["doc", "page"], "left")
    status = F.when(F.col("state").isNull(), F.lit("out-of-range")).when(F.col("state") != "processed", F.col("state")).when(F.col("limit_code").isNotNull(), F.lit("capability-limited")).otherwise(F.lit("ok"))
    return both.select("doc", "page", status.alias("status"))


def charge(items: DataFrame, cost: str, ceiling: int, *group: str, order: str) -> DataFrame:
    """Items with spent and over: the running sum, and whether it goes over the ceiling."""
    spent = F.sum(cost).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return items.withColumn("spent", spent).withColumn("over", F.col("spent") > ceiling)


def withhold(items: DataFrame, ceiling: int, *group: str) -> DataFrame:
    """(group.., n, withheld): lists over the ceiling are withheld as a whole, their count is kept."""
    return items.groupBy(*group).agg(F.count("*").alias("n")).withColumn("withheld", F.col("n") > ceiling)


def unread(entries: DataFrame, read: DataFrame, name: str = "name") -> DataFrame:
    """Entries that no reader read."""
    return entries.join(read.select(name).distinct(), name, "left_anti")


def duplicates(entries: DataFrame, *key: str) -> DataFrame:
    """(key.., n) of names that stand twice, which a package may not have."""
    return entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def named_bits(rows: DataFrame, flags: str, names: dict[int, str]) -> DataFrame:
    """Rows with the names of set bits, counted from 1, and the set bits that have no name."""
    bit = lambda k: F.shiftright(flags, k - 1).bitwiseAND(F.lit(1)) == 1
    known = F.array_compact(F.array(*(F.when(bit(k), F.lit(n)) for k, n in sorted(names.items()))))
    other = F.array_compact(F.array(*(F.when(bit(k), F.lit(k)) for k in range(1, 33) if k not in names)))
    return rows.withColumn("named", known).withColumn("unnamed", other)


def bind(structure: DataFrame, content: DataFrame, *key: str) -> DataFrame:
    """(key.., status): bound, structure-only or content-only."""
    both = structure.select(*key).distinct().withColumn("s", F.lit(1)).join(content.select(*key).distinct().withColumn("c", F.lit(1)), list(key), "full_outer")
    return both.select(*key, F.when(F.col("s").isNull(), "content-only").when(F.col("c").isNull(), "structure-only").otherwise("bound").alias("status"))
