import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/test-warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    """A value that compares across engines."""
    if v is None or isinstance(v, (bool, str)):
        return v
    f = float(v)
    return None if f != f else int(f) if f == int(f) else round(f, 9)


def same(df, relation):
    """Asserts that a Spark result and a DuckDB relation hold the same rows under the same column names."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    rows = [r.asDict() for r in df.collect()]
    ours = sorted(repr([plain(r[c]) for c in names]) for r in rows)
    at = [relation.columns.index(c) for c in names]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert ours == theirs
    return len(ours)
