"""Each query against its SQL in DuckDB, over the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__
from loomline import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got
    if name in (sql := queries.oracle_sql()):
        found = duck.execute(sql[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["idx", "cluster_id"] and found.count() > 0
    assert set(queries.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
