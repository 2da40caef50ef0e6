import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Spark's workers, wherever pytest starts


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a Spark result with what DuckDB says, whatever the order of rows."""
    import duckdb

    def norm(rows, columns, order):
        at = [columns.index(c) for c in order]
        return sorted(tuple("None" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)

    def check(df, sql, folder):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        cur = c.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert norm([tuple(r) for r in df.collect()], df.columns, sorted(columns)) == norm(cur.fetchall(), columns, sorted(columns))

    return check
