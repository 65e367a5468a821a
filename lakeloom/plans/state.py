"""Snapshot reads, data changes, constraint checks and statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import load
from ..operators import constraints, dml, statistics, temporal
from .registry import query

AT = "TIMESTAMP '2024-01-15 12:00:00'"
_NEWEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def _at():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")


@query(f"SELECT user_id, ts, event_id, event_type, value FROM ({_NEWEST} WHERE ts <= {AT}) t WHERE r = 1")
def asof_point(spark, sf_dir):
    return temporal.as_of(_events(spark, sf_dir), ["user_id"], "ts", "event_id", _at())


@query(f"""SELECT event_type, count(*) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM ({_NEWEST} WHERE ts <= {AT}) t WHERE r = 1 AND event_type <> 'error' GROUP BY event_type""")
def asof_snapshot_agg(spark, sf_dir):
    versions = _events(spark, sf_dir).withColumn("gone", F.col("event_type") == "error")
    text = "SELECT event_type, count(*) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM users_now GROUP BY event_type"
    return temporal.snapshot_query(spark, {"users_now": (versions, ["user_id"], "ts", "event_id", "gone")}, _at(), text)


@query(f"SELECT user_id, ts, event_id, event_type, value FROM ({_NEWEST}) t WHERE r = 1")
def version_latest(spark, sf_dir):
    return temporal.latest(_events(spark, sf_dir), ["user_id"], "ts", "event_id")


@query("SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events")
def version_interval(spark, sf_dir):
    return temporal.validity(_events(spark, sf_dir), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "valid_to")


@query(f"SELECT user_id, event_id, ts FROM events WHERE ts > {AT}")
def version_after(spark, sf_dir):
    return temporal.committed_after(_events(spark, sf_dir), "ts", _at()).select("user_id", "event_id", "ts")


@query(f"SELECT user_id, min(ts) AS ts FROM events WHERE ts > {AT} GROUP BY user_id")
def version_upper_bound(spark, sf_dir):
    return temporal.upper_bound(_events(spark, sf_dir), ["user_id"], "ts", _at())


@query("""WITH v AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
               r AS (SELECT user_id, ts AS rts FROM events WHERE event_type = 'view')
          SELECT v.user_id, v.ts, v.event_id, max(rts) AS last_read FROM v LEFT JOIN r ON v.user_id = r.user_id AND rts >= v.ts AND (nxt IS NULL OR rts < nxt) GROUP BY ALL""")
def version_last_read(spark, sf_dir):
    e = _events(spark, sf_dir)
    reads = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("rts"))
    return temporal.last_read(e.where("event_type = 'purchase'"), reads, ["user_id"], "ts", "event_id", "rts")


@query("""SELECT c_custkey, c_name, c_nationkey FROM customer
          UNION ALL SELECT 1000000 + n_nationkey, 'new ' || n_name, n_nationkey FROM nation""")
def dml_insert_ignore(spark, sf_dir):
    old = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = load(spark, sf_dir, "nation")
    new = n.select((F.col("n_nationkey") + 1000000).cast("long").alias("c_custkey"), F.concat(F.lit("new "), "n_name").alias("c_name"), F.col("n_nationkey").alias("c_nationkey"))
    clash = old.limit(50).withColumn("c_name", F.lit("clash"))
    return dml.insert_ignore(old, new.unionByName(clash).unionByName(new), ["c_custkey"])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey + 10000000, 'N', NULL FROM orders WHERE o_orderstatus = 'P'")
def dml_insert_select(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    more = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"))
    return dml.insert(o.where("o_orderstatus = 'O'"), more, {"o_orderstatus": F.lit("N")})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return dml.update(c, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("DEBT")})


@query("SELECT p_partkey, p_size FROM part WHERE NOT coalesce(nullif(p_size, 5) < 20, false)")
def dml_delete(spark, sf_dir):
    return dml.delete(load(spark, sf_dir, "part").select("p_partkey", "p_size"), F.nullif(F.col("p_size"), F.lit(5)) < 20)


@query("""WITH d AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id % 2 = 0)
          SELECT user_id, 'base' AS event_type, 0.0::DOUBLE AS value FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 2 <> 0
          UNION ALL SELECT user_id, event_type, value FROM d WHERE r = 1 AND event_type <> 'error'""")
def delta_merge_tombstone(spark, sf_dir):
    e = _events(spark, sf_dir)
    base = e.select("user_id").distinct().select("user_id", F.lit("base").alias("event_type"), F.lit(0.0).alias("value"))
    delta = e.where("user_id % 2 = 0").withColumn("gone", F.col("event_type") == "error")
    return dml.merge_delta(base, delta, ["user_id"], ["ts", "event_id"], "gone")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def chk_pk(spark, sf_dir):
    return constraints.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def chk_fk(spark, sf_dir):
    parents = load(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    return constraints.orphans(load(spark, sf_dir, "nation"), "n_regionkey", parents, "r_regionkey").select("n_nationkey", "n_regionkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal >= 0")
def chk_check(spark, sf_dir):
    return constraints.failing(load(spark, sf_dir, "customer"), F.col("c_acctbal") >= 0).select("c_custkey", "c_acctbal")


@query("SELECT 'l_returnflag' AS column_name, count(*) FILTER (WHERE nullif(l_returnflag, 'R') IS NULL) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem")
def chk_not_null(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return constraints.nulls(lines, ["l_returnflag", "l_quantity"])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def chk_fk_set_null(spark, sf_dir):
    gone = load(spark, sf_dir, "region").where("r_regionkey = 1")
    return constraints.cascade_delete(load(spark, sf_dir, "nation"), "n_regionkey", gone, "r_regionkey", "set null").select("n_nationkey", "n_regionkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def chk_fk_cascade(spark, sf_dir):
    gone = load(spark, sf_dir, "nation").where("n_regionkey = 1")
    return constraints.cascade_delete(load(spark, sf_dir, "supplier"), "s_nationkey", gone, "n_nationkey").select("s_suppkey")


@query("SELECT k, count(*) AS n FROM (SELECT NULLIF(n_regionkey, 3) AS k FROM nation) t WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1")
def chk_unique(spark, sf_dir):
    """UNIQUE lets nulls repeat."""
    return constraints.repeated_values(load(spark, sf_dir, "nation").select(F.nullif("n_regionkey", F.lit(3)).alias("k")), ["k"])


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")
def chk_fk_restrict(spark, sf_dir):
    """The regions that can't be deleted while some nations refer to them."""
    few = load(spark, sf_dir, "nation").where("n_nationkey < 3")
    return constraints.referenced(load(spark, sf_dir, "region"), "r_regionkey", few, "n_regionkey").select("r_regionkey", "r_name")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def chk_fk_set_default(spark, sf_dir):
    gone = load(spark, sf_dir, "region").where("r_regionkey = 1")
    return constraints.cascade_delete(load(spark, sf_dir, "nation"), "n_regionkey", gone, "r_regionkey", "set default", F.lit(0)).select("n_nationkey", "n_regionkey")


@query("SELECT CASE WHEN s_nationkey = 7 THEN s_suppkey + 5000000 ELSE s_suppkey END AS s_suppkey, s_name FROM supplier")
def dml_update_key(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return dml.update(s, F.col("s_nationkey") == 7, {"s_suppkey": F.col("s_suppkey") + 5000000}).drop("s_nationkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE false")
def dml_truncate(spark, sf_dir):
    return dml.truncate(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"))


@query("""WITH v AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 10 <> 3)
          SELECT user_id, event_id, ts, value FROM v WHERE r = 1""")
def version_purge(spark, sf_dir):
    """Writes that are rolled back leave the versions before them the newest."""
    purged = load(spark, sf_dir, "events").where("event_id % 10 = 3").select("event_id")
    left = dml.delete_from(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), purged, ["event_id"])
    return temporal.latest(left, ["user_id"], "ts", "event_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, (count(*) - count({c})) / count(*) AS null_fraction, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")))
def stats_columns(spark, sf_dir):
    return statistics.analyze(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], exact=True)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def stats_topk_values(spark, sf_dir):
    return statistics.top_values(load(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT CAST(i - 1 AS INT) AS bound, q[i] AS value FROM (SELECT unnest(range(1, 10)) AS i),
              (SELECT quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lineitem)""")
def stats_histogram_equiheight(spark, sf_dir):
    return statistics.equi_height(load(spark, sf_dir, "lineitem"), "l_quantity", 10)


@query("""SELECT CAST(year(o_orderdate) AS INT) AS zone, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey,
              min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY ALL""")
def stats_zone_map(spark, sf_dir):
    return statistics.zone_map(load(spark, sf_dir, "orders").withColumn("zone", F.year("o_orderdate")), "zone", ["o_orderkey", "o_totalprice"])


@query()
def stats_hll(spark, sf_dir):
    return statistics.analyze(load(spark, sf_dir, "lineitem"))


@query()
def stats_sketches(spark, sf_dir):
    return statistics.sketches(load(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT l_partkey, n, true AS not_too_low, true AS near FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) t""")
def stats_count_min_frequency(spark, sf_dir):
    """Frequencies read from the sketch, held against the exact ones (near: within ten times eps of all rows)."""
    lines = load(spark, sf_dir, "lineitem")
    estimates = statistics.frequency(statistics.count_min(lines, "l_partkey"), lines, "l_partkey")
    rows = lines.agg(F.count(F.lit(1)).alias("all_rows"))
    both = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).join(estimates, "l_partkey").crossJoin(F.broadcast(rows))  # one row
    return both.select("l_partkey", "n", (F.col("estimate") >= F.col("n")).alias("not_too_low"), (F.col("estimate") - F.col("n") <= 10 * statistics.CMS_EPS * F.col("all_rows")).alias("near"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY md5('1|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50)
          SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM s JOIN lineitem ON l_orderkey = o_orderkey""")
def stats_join_sample(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return statistics.join_sample(o, lines, "o_orderkey", "o_orderkey", 50)


@query("SELECT * FROM orders ORDER BY md5('1|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def stats_sample(spark, sf_dir):
    return statistics.sampled(load(spark, sf_dir, "orders"), "o_orderkey", 100)
