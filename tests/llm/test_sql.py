"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lakeloom.llm import queries


def plain(v):
    return repr(round(v, 9) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(columns).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())
