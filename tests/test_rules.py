"""Rules on hand-made rows: ties, tolerances, Unicode, empty inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import strings as S
from quire.operators import layout as L
from quire.operators import project as P
from quire.operators import search as Q
from quire.operators import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("text", "value"), [("1,234.5", "1234.5"), ("(12)", "-12"), ("−3%", "-3"), ("$4 bn", "4000000000"), ("1,23", None), ("12a", None), ("5k", "5000"), ("", None), ("1.1234567", None), ("(12", "12")])
def test_number(spark, text, value):
    got = one(spark, S.number(F.lit(text)))
    assert (got is None) == (value is None) and (value is None or float(got) == float(value))


@pytest.mark.parametrize(("text", "yes"), [("• x", True), ("1. x", True), ("(a) x", True), ("1234. x", False), ("ab. x", False), ("-x", False), (" • x", True), ("", False)])
def test_marker(spark, text, yes):
    assert one(spark, S.opens_with_marker(F.lit(text))) is yes


@pytest.mark.parametrize(("text", "depth"), [("2.1.3 x", 3), ("IV. x", 1), ("2. x", 1), ("IV x", None), ("2..1 x", None), ("2", None)])
def test_section(spark, text, depth):
    assert one(spark, S.section_number(F.lit(text))) == depth


def test_normalize_unicode(spark):
    assert one(spark, S.normalize(F.lit(" a  \n b\t"))) == "a b"


def test_json_escapes(spark):
    assert one(spark, S.json_string(F.lit('a"\\\n\x1f é'))) == '"a\\"\\\\\\n\\u001f é"'


@pytest.mark.parametrize(("target", "part"), [("a/./b", "xl/a/b"), ("/x//y", "x/y"), ("../z", "z"), ("../../z", "")])
def test_target(spark, target, part):
    assert one(spark, S.resolve_target(F.lit("xl/w.xml"), F.lit(target))) == part


def test_quantize(spark):
    assert [one(spark, G.quantize(F.lit(x))) for x in (0.005, -0.005, 1.0, float("nan"))] == [1, -1, 100, None]


def test_fold_does_not_chain(spark):
    assert one(spark, L.fold(F.array(*(F.lit(x) for x in (100, 90, 240, 250, 600))))) == [90, 250, 600]


def test_leading_needs_size_and_share(spark):
    y = [(1, 0), (1, 1200), (1, 2400), (1, 4800), (2, 0), (2, 500), (2, 1000)]
    line = L.lines(spark.createDataFrame(y, "p int, y0 long"), "p")
    assert [tuple(r) for r in L.leading(line, "p").collect()] == [(1, 1200)]


def test_single_block_has_no_number(spark):
    runs = spark.createDataFrame([(1, 0, 0), (1, 1, 1200)], "p int, ord long, y0 long")
    assert [r["block"] for r in L.blocks(runs, "p").collect()] == [None, None]


def test_overlapping_occurrences(spark):
    found = Q.locate(spark.createDataFrame([(1, "aaa😀aa")], "block long, text string"), spark.createDataFrame([(7, "aa"), (8, ""), (9, "zz")], "quote long, text string"))
    assert sorted((r["quote"], r["start"], r["length"]) for r in found.collect()) == [(7, 0, 2), (7, 1, 2), (7, 4, 2)]


def test_quotes_that_cannot_be_asked(spark):
    q = spark.createDataFrame([(1, ""), (2, "x" * 16385), (3, "ok"), (4, None)], "quote long, text string")
    assert sorted(r["quote"] for r in Q.refused(q).collect()) == [1, 2, 4]


def test_cover_faults(spark):
    cells = spark.createDataFrame([("t", "a", 0, 0, 1, 2, ""), ("t", "b", 0, 1, 1, 1, ""), ("t", "c", 1, 1, 1, 2, "")], "tbl string, cell string, r long, c long, rowspan long, colspan long, text string")
    got = {(r["sr"], r["sc"]): r["fault"] for r in T.faults(cells, spark.createDataFrame([("t", 2, 2)], "tbl string, n_rows long, n_cols long")).collect()}
    assert got == {(0, 1): "owned-more-than-once", (1, 0): "unowned", (1, 2): "outside-grid"}


def test_segments_tile(spark):
    runs = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "é")], "d long, ord long, text string")
    segs = P.segments(runs, "d", "ord")
    assert [(r["s_start"], r["s_end"], r["kind"]) for r in segs.orderBy("segment").collect()] == [(0, 1, "source"), (1, 3, "syntax"), (3, 5, "source")]
    assert P.tiling(segs, "d").first()["tiles"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, ord long, page long, text string, x0 long, y0 long, x1 long, y1 long, em long, bold boolean")
    assert L.blocks(empty, "doc_id").count() == 0
    assert L.body_em(empty, "doc_id", "ord").count() == 0
    assert P.markdown(empty.withColumn("level", F.lit(None).cast("int")), "doc_id", "ord").count() == 0


def test_pages_over_many_batches(spark):
    """Pages that end within a batch, at its edge and go on over several; null pages; no frame for each page."""
    from quire.operators import pages

    sizes = {1: 3, 2: 4, 3: 40, 4: 1, None: 9, 5: 7}
    rows = [(p, k, 0, 1000 * k, 100, 1000 * k + 1000, None, k % 4 == 0) for p, n in sizes.items() for k in range(n)]
    lines = spark.createDataFrame(rows, "p long, ord long, x0 long, y0 long, x1 long, y1 long, heading int, marker boolean").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        units = pages.units(lines, "p")
        assert "FlatMapGroupsInPandas" not in units._jdf.queryExecution().toString()
        assert {(r["p"], r["ord"]): r["unit"] for r in units.collect()} == {(p, k): k // 4 for p, n in sizes.items() for k in range(n)}
        read = pages.reading_order(lines, "p").collect()
        assert sorted((str(r["p"]), r["ord"], r["read"], r["region"]) for r in read) == sorted((str(p), k, k, None) for p, n in sizes.items() for k in range(n))
        boxes = pages.touching(lines.withColumn("id", F.col("ord") + 5), "p")
        assert {r["cluster"] for r in boxes.collect()} == {5} and boxes.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pages.units(lines.limit(0), "p").count() == 0
