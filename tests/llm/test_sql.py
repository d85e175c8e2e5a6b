"""Queries of the subpackage against their SQL on the smallest tables, where these are at hand."""

import os

import pytest

from treeloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
#: Queries that show nothing on a hundred documents.
LARGER = {"p7_checked": "/root/testdata/sf0.01"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    data, con = LARGER.get(name, DATA), duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
