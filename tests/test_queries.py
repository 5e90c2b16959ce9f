"""Every ticket query against its SQL in DuckDB, on the driver's small tables."""

import os

import duckdb
import pytest

from quaystone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in ("events", "documents", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
    assert sorted(names) == columns
    assert mine == theirs
