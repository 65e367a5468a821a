"""The operators on small frames: nulls, ties, duplicates, empty tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import postgres as pg
from lakeloom.operators import constraints, dml, ranges, statistics, temporal
from lakeloom.sources import delimited
from lakeloom.streaming import events as streams

VERSIONS = "k string, ts int, id int, gone boolean, val string"


def versions(spark):
    rows = [("a", 4, 6, False, "x"), ("a", 3, 5, False, "y"), ("a", 5, 7, True, None), ("b", 2, 4, False, "p"), ("b", 2, 9, False, "q"), (None, 1, 1, False, "n")]
    return spark.createDataFrame(rows, VERSIONS)


def test_as_of_orders_by_timestamp_then_id(spark):
    v = versions(spark)
    at = lambda t: {r.k: r.val for r in temporal.as_of(v, ["k"], "ts", "id", t, "gone").collect()}
    assert at(0) == {} and at(1) == {None: "n"} and at(2) == {"b": "q", None: "n"} and at(4) == {"a": "x", "b": "q", None: "n"}
    assert at(5) == {"b": "q", None: "n"} == {r.k: r.val for r in temporal.latest(v, ["k"], "ts", "id", "gone").collect()}


def test_version_reads_against_brute_force(spark):
    r = random.Random(1)
    rows = list({(k, r.randint(0, 9), i): None for i in range(60) for k in [r.choice("abc")]})
    reads = [(r.choice("abcd"), r.randint(0, 12)) for _ in range(40)]
    v = spark.createDataFrame(rows, "k string, ts int, id int")
    after = {x.k: x.ts for x in temporal.upper_bound(v, ["k"], "ts", 4).collect()}
    assert after == {k: min(t for a, t, _ in rows if a == k and t > 4) for k in "abc" if any(a == k and t > 4 for a, t, _ in rows)}
    seen = {(x.k, x.ts, x.id): x.last_read for x in temporal.last_read(v, spark.createDataFrame(reads, "k string, r int"), ["k"], "ts", "id", "r").collect()}
    want = {x: None for x in rows}
    for k, t in reads:
        before = [x for x in rows if x[0] == k and x[1] <= t]
        if before:
            x = max(before, key=lambda x: x[1:])
            want[x] = max(t, want[x] if want[x] is not None else t)
    assert seen == want
    ends = {(x.k, x.ts, x.id): x.valid_to for x in temporal.validity(v, ["k"], "ts", "id").collect()}
    for k, t, i in rows:
        later = sorted(x[1:] for x in rows if x[0] == k and x[1:] > (t, i))
        assert ends[k, t, i] == (later[0][0] if later else None)


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (None, "z")], "k int, v string")
    assert sorted(map(tuple, dml.insert_ignore(t, spark.createDataFrame([(2, "n"), (3, "m"), (3, "l")], "k int, v string"), ["k"]).where("k >= 2").collect()), key=str) == [(2, None), (3, "l")]
    assert {r.v for r in dml.update(t, F.col("k") > 1, {"v": F.lit("new")}).collect()} == {"a", "new", "z"}
    assert {r.k for r in dml.delete(t, F.col("v") == "a").collect()} == {2, None}
    delta = spark.createDataFrame([(1, "b", 1, False), (1, "c", 2, False), (2, None, 1, True), (9, "i", 5, False)], "k int, v string, o int, gone boolean")
    assert sorted(map(tuple, dml.merge_delta(t, delta, ["k"], ["o"], "gone").collect()), key=str) == [(1, "c"), (9, "i"), (None, "z")]
    assert dml.insert(t, spark.createDataFrame([(7,)], "k int"), {"v": F.lit("d")}).where("v = 'd'").count() == 1


def test_constraints(spark):
    t = spark.createDataFrame([(1, 10), (1, 20), (2, None), (None, 30)], "k int, p int")
    assert {(r.k, r.n) for r in constraints.duplicate_keys(t, ["k"]).collect()} == {(1, 2), (None, 1)}
    parents = spark.createDataFrame([(10,), (30,)], "id int")
    assert [r.p for r in constraints.orphans(t, "p", parents, "id").collect()] == [20]
    assert [r.p for r in constraints.failing(t, F.col("p") < 25).collect()] == [30]
    assert {r.column_name: r.n for r in constraints.nulls(t, ["k", "p"]).collect()} == {"k": 1, "p": 1}
    assert constraints.cascade_delete(t, "p", parents, "id").count() == 2
    assert sorted(r.p or 0 for r in constraints.cascade_delete(t, "p", parents, "id", "set null").collect()) == [0, 0, 0, 20]
    with pytest.raises(ValueError):
        constraints.cascade_delete(t, "p", parents, "id", "explode")


def test_statistics(spark):
    t = spark.createDataFrame([(i % 7 or None, "x") for i in range(100)], "a int, b string")
    rows = {r.column_name: r for r in statistics.analyze(t, exact=True).collect()}
    assert (rows["a"].n, rows["a"].n_null, rows["a"].n_distinct, rows["b"].n_distinct) == (100, 15, 6, 1) and rows["a"].null_fraction == 0.15
    assert statistics.analyze(t.limit(0)).first().null_fraction is None
    assert [r.n for r in statistics.top_values(t, "a", 2).collect()] == [15, 15]
    wide = statistics.analyze(spark.range(50_000)).first().n_distinct
    assert abs(wide / 50_000 - 1) < 0.2
    assert [r.id for r in statistics.sampled(spark.range(99), "id", 5).collect()] == [r.id for r in statistics.sampled(spark.range(99).repartition(3), "id", 5).collect()]


def test_range_join(spark):
    r = random.Random(2)
    a, b = ([(r.choice("xy"), r.randint(-20, 20)) for _ in range(40)] for _ in range(2))
    got = sorted((x.k, x.t, x.right_t) for x in ranges.range_join(spark.createDataFrame(a, "k string, t int"), spark.createDataFrame(b, "k string, t int"), ["k"], "t", 6).collect())
    assert got == sorted((k, t, u) for k, t in a for m, u in b if k == m and t < u <= t + 6)


def test_postgres_functions(spark):
    one = spark.range(1)
    parts = {"century": 20, "decade": 200, "millennium": 2, "dow": 0, "doy": 366, "week": 52, "second": 59.25, "microsecond": 59_250_000, "nothing": None}
    ts = F.expr("TIMESTAMP_NTZ '2000-12-31 23:59:59.25'")
    got = one.select(*(pg.date_part(p, ts).alias(p) for p in parts)).first().asDict()
    assert got == parts
    cut = one.select(*(pg.date_trunc(p, ts).alias(p) for p in ("century", "millennium", "decade", "week", "nothing"))).first().asDict()
    assert {k: v and v.isoformat()[:10] for k, v in cut.items()} == {"century": "2001-01-01", "millennium": "2001-01-01", "decade": "2000-01-01", "week": "2000-12-25", "nothing": None}
    dates = spark.createDataFrame([("2024-02-29",), ("2023/2/29",), ("x",), (None,)], "s string").select(pg.to_date(F.col("s")).alias("d")).collect()
    assert [r.d for r in dates] == [datetime.date(2024, 2, 29), None, None, None]
    assert one.select(pg.from_julian_day(pg.julian_day(F.lit(datetime.date(1999, 3, 1)))).alias("d")).first().d == datetime.date(1999, 3, 1)
    assert one.select(pg.like(F.lit("ABC"), "a%c").alias("x")).first().x and one.select(pg.int_div(F.lit(-7), F.lit(2)).alias("x")).first().x == -3


def test_delimited_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, 'q"uo,te'), (None, "x"), (3, "é")], schema)
    delimited.write_csv(df, str(tmp_path / "csv"), escape='"')
    assert sorted(map(str, delimited.read_csv(spark, str(tmp_path / "csv"), schema).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "n.tbl").write_text("0|AFRICA   \n1|ASIA     \n")
    assert [r.b for r in delimited.read_tbl(spark, str(tmp_path / "n.tbl"), schema).collect()] == ["AFRICA", "ASIA"]
    (tmp_path / "t.json").write_text('{"t1": {"table_name": "t1", "column_names_and_types": [["col1", "INT"], ["col2", "VARCHAR(9)"]], "primary_key_col_idx": [0], "row_data_path": "t1.csv"}}')
    (tmp_path / "t1.csv").write_text('"(col1,INT)","(col2,VARCHAR)"\n10,val\n20,val2\n')
    assert list(map(tuple, delimited.read_described(spark, str(tmp_path / "t.json"), "t1", f"{tmp_path}/").collect())) == [(10, "val"), (20, "val2")]
    assert delimited.described_schemas(spark, str(tmp_path / "t.json"))["t1"]["key"] == ["col1"]
    with pytest.raises(ValueError):
        delimited.column_type("blob")


def test_streams(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), table.schema, 1)
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM hourly").first().n == table.count()
    out = str(tmp_path / "out")
    streams.latest_versions(stream, ["user_id"], "ts", "event_id", out, str(tmp_path / "ck")).awaitTermination(120)
    got = temporal.latest(spark.read.parquet(out), ["user_id"], "ts", "event_id").select("user_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, temporal.latest(table, ["user_id"], "ts", "event_id").select("user_id", "event_id").collect()))


def test_errors_are_raised(spark):
    """Division by zero, overflow, casts out of range, text that is no number."""
    for text in ("SELECT 1 div (id - id) FROM range(1)", "SELECT id % (id - id) FROM range(1)", "SELECT CAST(9223372036854775807 AS BIGINT) + id FROM range(1, 2)", "SELECT CAST(id + 300 AS TINYINT) FROM range(1)",
                 "SELECT CAST(concat('x', id) AS INT) FROM range(1)", "SELECT CAST(2147483647 AS INT) * CAST(id + 2 AS INT) FROM range(1)", "SELECT id FROM range(1) WHERE concat('x', id) = 3"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|REMAINDER_BY_ZERO|ARITHMETIC_OVERFLOW|CAST_OVERFLOW|CAST_INVALID_INPUT"):
            spark.sql(text).collect()
    assert spark.sql("SELECT try_cast('x1' AS INT) AS a, try_divide(1, 0) AS b").first()[:] == (None, None)


def test_foreign_keys_refuse(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 10), (None, 11)], "k int, v int")
    for action in ("restrict", "no action"):
        with pytest.raises(ValueError, match="refer"):
            constraints.cascade_delete(children, "k", parents.where("k = 1"), "k", action)
        assert constraints.cascade_delete(children, "k", parents.where("k = 2"), "k", action).count() == 2
    assert {r.v: r.k for r in constraints.cascade_delete(children, "k", parents, "k", "set default").collect()} == {10: None, 11: None}
    nulls = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3)], "a int, b int")
    assert [tuple(r) for r in constraints.repeated_values(nulls, ["a", "b"]).collect()] == [(2, 3, 2)] and constraints.duplicate_keys(nulls, ["a", "b"]).count() == 2


def test_updates_from_another_table(spark):
    t = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k int, v int")
    c = spark.createDataFrame([(1, 10), (9, 1)], "k int, add int")
    assert {r.k: r.v for r in dml.update_from(t, c, ["k"], {"v": F.col("v") + F.col("add")}).collect()} == {1: 15, 2: 6, None: 7}
    assert {r.k for r in dml.delete_from(t, c, ["k"]).collect()} == {2, None} and dml.truncate(t).count() == 0


def test_stock_refills_alike_in_any_order(spark):
    """The closed form of the refill rule against the rule itself."""
    r = random.Random(4)
    for _ in range(300):
        start, taken = r.randint(10, 100), [r.randint(1, 50) for _ in range(r.randint(0, 12))]
        s = start
        for x in taken:
            s = s - x if s - x >= 10 else s - x + 91
        assert s == 10 + (start - sum(taken) - 10) % 91


def test_timestamps_need_no_zone(spark):
    """Hours that a zone skips stay, whatever the session's zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    t = spark.createDataFrame([(datetime.datetime(2024, 3, 10, 2, 30, 15, 123456),)], "t timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = t.select(*(pg.date_trunc(p, F.col("t")).alias(p) for p in ("day", "hour", "minute", "second", "millisecond", "microsecond", "week", "year")), pg.epoch_micros(F.col("t")).alias("us")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    d = datetime.datetime
    assert got[:] == (d(2024, 3, 10), d(2024, 3, 10, 2), d(2024, 3, 10, 2, 30), d(2024, 3, 10, 2, 30, 15), d(2024, 3, 10, 2, 30, 15, 123000), d(2024, 3, 10, 2, 30, 15, 123456), d(2024, 3, 4), d(2024, 1, 1), 1710037815123456)


def test_views_and_schemas_go(spark, sf):
    from lakeloom.catalog import sql
    from lakeloom.plans import files, registry

    assert sql(spark, sf, "SELECT l_partkey FROM lineitem WHERE l_partkey < 0").count() == 0
    registry.queries()["asof_snapshot_agg"](spark, sf).count()
    assert registry.queries()["ddl_create_insert_select"](spark, sf).count() > 0
    assert not {t.name for t in spark.catalog.listTables()} & {"part", "lineitem", "users_now", "orders"}
    assert files.drop_made(spark) and not spark.catalog.listDatabases("lakeloom_*")


def test_large_joins_may_use_bloom_filters(spark, tmp_path):
    """A selective side's keys filter the other side's scan before the shuffle."""
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    spark.range(200_000).withColumn("k", F.col("id") % 5000).write.parquet(str(tmp_path / "big"))
    spark.range(5000).withColumn("name", F.concat(F.lit("n"), "id")).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "small"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(str(tmp_path / "big")).join(spark.read.parquet(str(tmp_path / "small")).where("name = 'n77'"), "k")
        assert df.count() == 40 and "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
