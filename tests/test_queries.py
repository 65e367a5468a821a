"""Every registered relational query against DuckDB on the smallest tables, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakeloom.plans import registry


def value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else None
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


#: Queries whose order is a part of the result, and total.
ORDERED = {n for n in registry.queries() if n in ("sort_multi_key", "sort_nulls", "topk", "limit_offset", "sort_expression", "latest_row", "scan_index_range", "ycsb_scan", "retwis_timeline", "seats_find_flights_shape", "auction_due_items", "stats_topk_values", "ch_q01", "ch_q13", "ch_q18", "ch_q22")}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    text = registry.oracle_sql().get(name)
    if text is None:
        assert got
        return
    want = duck.execute(text)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    data = want.fetchall()
    assert rows(df.columns, got) == rows(columns, data)
    if name in ORDERED:
        assert [tuple(value(r[c]) for c in columns) for r in got] == [tuple(map(value, r)) for r in data]


def test_new_items_of_ids_that_are_taken(spark, tmp_path):
    """New items whose ids are those of old ones, repeated or null are inserted all the same."""
    data = [(0, "a", "t", 1), (5, "b", "u", 1), (5, "b", "u", 1), (7, "c", "v", 1), (7, "c", "w", 1), (1000000, "d", "x", 50), (1000005, "e", "y", 2), (2000000, None, "z", 41), (None, "f", None, 1), (None, "f", "t", 1), (3, "g", "t", None)]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = registry.queries()["auction_new_and_updated_items"](spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()["auction_new_and_updated_items"])
    got = rows(df.columns, df.collect())
    assert got == rows([d[0] for d in want.description], want.fetchall()) and len(got) == 18


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())


def test_nothing_outside_imports_the_llm_part():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for f in [*(root / "lakeloom").rglob("*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert "lakeloom.llm" not in f.read_text() and "from ..llm" not in f.read_text(), f
