"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import os

import pytest

import __spark_entry__ as entry
from treeloom.operators import queries as quality
from treeloom.plans import queries as documents

DATA = "/root/testdata/sf0.001"
NAMES = sorted({**documents.SQL, **quality.SQL})


def canonical(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(tuple(r[c] for c in columns) for r in got.collect()) == canonical(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
