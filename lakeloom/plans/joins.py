"""A query for each kind of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import load
from ..functions import postgres as pg
from .registry import query, sql_query

sql_query("join_inner_hash", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
sql_query("join_residual_predicate", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '90' DAY")
sql_query("join_left", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
sql_query("join_right", "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9900")
sql_query("join_full", """
    SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key
    FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey""")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_nl_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql_query("join_self", "SELECT n1.n_name AS one, n2.n_name AS other FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
sql_query("join_computed_key", """
    SELECT s_name, COUNT(*) AS lines FROM lineitem JOIN supplier ON (l_partkey * l_suppkey) % 100 = s_suppkey GROUP BY s_name""")
sql_query("join_disjunctive", """
    SELECT COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem, part
    WHERE (l_partkey = p_partkey AND p_size < 5 AND l_quantity > 40) OR (l_partkey = p_partkey AND p_brand = 'Brand#1' AND l_quantity < 5)""")
sql_query("join_left_on_filter", """
    SELECT c_custkey, COUNT(o_orderkey) AS big_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000 GROUP BY c_custkey""")
sql_query("join_anti_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql_query("join_semi_in", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
sql_query("join_not_in_null_aware", """
    SELECT 'with null' AS kind, COUNT(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END FROM region)
    UNION ALL SELECT 'without' AS kind, COUNT(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)""")
sql_query("join_scalar_subquery", """
    SELECT p_partkey, (SELECT MAX(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part WHERE p_size = 7""")
sql_query("join_multiway", """
    SELECT r_name, COUNT(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
sql_query("join_null_safe", """
    SELECT a.k AS a_key, b.k AS b_key FROM (SELECT NULLIF(n_regionkey, 2) AS k FROM nation) a
    JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k""")
sql_query("derived_table", """
    SELECT d.status, d.n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) AS d WHERE d.n > 10""")


@query("SELECT o_orderkey, COUNT(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge_hint(spark, sf_dir):
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return orders.hint("merge").join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""
    SELECT COUNT(DISTINCT l_partkey) AS low_stock
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey >= 1000 AND l_orderkey < 1020 AND p_size < 20""")
def join_band(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_orderkey >= 1000 AND l_orderkey < 1020")
    return lines.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where("p_size < 20").agg(F.countDistinct("l_partkey").alias("low_stock"))


@query("""
    SELECT a.event_id, count(b.event_id) AS near FROM events a LEFT JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '6' HOUR GROUP BY a.event_id""")
def join_range_binned(spark, sf_dir):
    from ..operators.ranges import range_join

    e = load(spark, sf_dir, "events").select("event_id", "user_id", pg.epoch_micros(F.col("ts")).alias("t"))
    near = range_join(e, e, keys=["user_id"], at="t", width=6 * 3_600_000_000)
    found = near.groupBy("event_id").agg(F.count("right_event_id").alias("near"))
    return e.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("near", F.lit(0)).alias("near"))
