"""Every query of the catalogue against its SQL, over the smallest tables."""

import pytest

from quire.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(catalogue.QUERIES[name](spark, FOLDER), catalogue.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, FOLDER).count()


def test_two_runs_agree(spark):
    a, b = (sorted(map(tuple, catalogue.QUERIES["locate_parts"](spark, FOLDER).collect())) for _ in range(2))
    assert a == b


def test_tree_has_every_customer(spark):
    folder = FOLDER.replace("0.001", "0.01")
    ids = {r[0] for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect()}
    role = ("Document", "Sect", "L", "LI", "P")
    path = lambda n: [*(path(n // 2) if n > 1 else []), role[n % 5]]
    got = {r["id"]: (r["depth"], r["path"]) for r in catalogue.QUERIES["tree_paths"](spark, folder).collect()}
    assert len(ids) > 1000 and got == {n: (len(path(n)) - 1, "/".join(path(n))) for n in ids}


def test_tree_sends_no_rows_to_the_driver(spark):
    plan = catalogue.QUERIES["tree_paths"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "UnionLoop" not in plan and "Broadcast" not in plan


def test_tree_of_odd_nodes(spark):
    """Two roots, a repeated node, a lost parent, a cycle, a node of itself, and a chain past the deepest level."""
    from quire.operators import trees

    rows = [(1, None, "a"), (2, None, "b"), (3, 1, "c"), (3, 1, "d"), (4, 3, "e"), (5, 99, "f"), (6, 7, "g"), (7, 6, "h"), (8, 8, "i"), (9, 2, None), *((100 + k, 100 + k - 1 if k else 2, "z") for k in range(70))]
    got = sorted(map(str, (tuple(r) for r in trees.paths(spark.createDataFrame(rows, "id long, parent long, role string"), 3).collect())))
    chain = [(100 + k, k + 1, "b" + "/z" * (k + 1)) for k in range(64)]
    assert got == sorted(map(str, [(1, 0, "a"), (2, 0, "b"), (3, 1, "a/c"), (3, 1, "a/d"), (4, 2, "a/c/e"), (4, 2, "a/d/e"), (9, 1, None), *chain]))


def test_slots_are_dealt_once_by_size(spark, monkeypatch):
    from quire.plans import views

    name = "table_slots"
    before = catalogue.QUERIES[name](spark, FOLDER)
    assert before._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(views, "CELL_BYTES", 1 << 12)
    finer = catalogue.QUERIES[name](spark, FOLDER)
    assert finer.rdd.getNumPartitions() > 2 * before.rdd.getNumPartitions()
    assert sorted(map(tuple, finer.collect())) == sorted(map(tuple, before.collect()))
