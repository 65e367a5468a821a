"""Scans, predicates, aggregation, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import load
from ..functions import postgres as pg
from .registry import query, sql_query


def money(x: str) -> str:
    """The sum of x, exact and the same in any order: each value is rounded to cents before it is added."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


# Scans and predicates.
sql_query("scan_project", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus AS status FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'")
sql_query("scan_star", "SELECT * FROM nation")
sql_query("scan_filter_3vl", """
    SELECT a, b, a AND b AS both, a OR b AS any_of, NOT a AS negated, a IS DISTINCT FROM b AS differ, a IS NULL AS missing, b IS NOT NULL AS present
    FROM (VALUES (true, true), (true, false), (true, NULL), (false, true), (false, false), (false, NULL), (NULL, true), (NULL, false), (CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN))) t(a, b)
    WHERE (a OR b) IS NOT FALSE""")
sql_query("scan_between_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linenumber IN (1, 3) AND l_returnflag NOT IN ('A', 'N')")
sql_query("scan_like_cs", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'b%t' AND p_name NOT LIKE '%_red%'")
sql_query("scan_like_ci", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'pro%'")
sql_query("scan_like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
sql_query("scan_dummy", "SELECT 1 AS one, 'x' AS x, CAST(2.5 AS DOUBLE) AS half")
sql_query("scan_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
sql_query("scan_index_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 140 ORDER BY o_orderkey DESC LIMIT 10")
sql_query("scan_inequality", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND value >= 90 AND value < 95")

# Aggregation.
sql_query("agg_plain", f"SELECT COUNT(*) AS n, {money('o_totalprice')} AS total, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most, {money('o_totalprice')} / COUNT(o_totalprice) AS mean FROM orders")
sql_query("agg_avg_nulls", "SELECT l_returnflag, AVG(NULLIF(l_linenumber, 2)) AS mean, COUNT(NULLIF(l_linenumber, 2)) AS n FROM lineitem GROUP BY l_returnflag")
sql_query("agg_plain_empty", "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_custkey) AS least, AVG(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0")
sql_query("agg_group_empty", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus")
sql_query("agg_group", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {money('l_quantity')} AS qty, MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_count_nulls", "SELECT COUNT(*) AS n, COUNT(NULLIF(l_returnflag, 'R')) AS not_r, COUNT(DISTINCT NULLIF(l_returnflag, 'R')) AS kinds FROM lineitem")
sql_query("agg_distinct", f"SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS numbers, CAST(AVG(DISTINCT l_linenumber) AS DOUBLE) AS mean_number FROM lineitem GROUP BY l_returnflag")
sql_query("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
sql_query("agg_having_subquery", f"SELECT l_suppkey, {money('l_quantity')} AS qty FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > (SELECT SUM(l_quantity) / COUNT(DISTINCT l_suppkey) FROM lineitem)")
sql_query("agg_conditional", "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderstatus")
sql_query("agg_ratio", f"SELECT l_linestatus, {money('CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END')} / {money('l_extendedprice')} AS share FROM lineitem GROUP BY l_linestatus")
sql_query("agg_of_agg", "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) c GROUP BY n")
sql_query("agg_weighted_avg", f"SELECT l_returnflag, {money('l_extendedprice * l_quantity')} / {money('l_quantity')} AS weighted FROM lineitem GROUP BY l_returnflag")
sql_query("agg_group_alias", "SELECT substring(o_orderpriority, 1, 1) AS level, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS yr, COUNT(*) AS n FROM orders GROUP BY level, yr")
sql_query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("agg_cube_extension", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")

# Sorting and limits: the order is total, so that the rows kept are defined.
sql_query("sort_multi_key", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey")
sql_query("sort_nulls", "SELECT x FROM (SELECT NULLIF(n_regionkey, 2) AS x, n_nationkey FROM nation) t ORDER BY x DESC NULLS FIRST, n_nationkey LIMIT 12")
sql_query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql_query("sort_expression", "SELECT c_custkey, c_acctbal FROM customer ORDER BY substring(c_mktsegment, 2, 2), abs(c_acctbal) DESC, c_custkey LIMIT 15")
sql_query("latest_row", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 1")

# Set operations over bags with duplicates and nulls.
LEFT, RIGHT = "SELECT NULLIF(n_regionkey, 4) AS k FROM nation", "SELECT NULLIF(n_nationkey % 3, 2) AS k FROM nation WHERE n_nationkey < 8"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql_query(_name, f"SELECT k FROM ({LEFT}) a {_op} SELECT k FROM ({RIGHT}) b")


@query("""SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_name, c_custkey) AS r, COUNT(*) OVER () AS n FROM customer WHERE c_nationkey = 3) t
              WHERE r = CAST(FLOOR((n + 1) / 2.0) AS BIGINT)""")
def middle_row(spark, sf_dir):
    """By a count and a place in a total order: Spark reads on through its sorted range partitions as far as the place."""
    rows = load(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name")
    return rows.orderBy("c_name", "c_custkey").offset(max(0, (rows.count() + 1) // 2 - 1)).limit(1)


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey = 7")
def view_create_use_drop(spark, sf_dir):
    """Views in place of tables: made, used and dropped; a DataFrame that uses them stays good."""
    load(spark, sf_dir, "nation").where("n_nationkey = 7").createOrReplaceTempView("seventh")
    load(spark, sf_dir, "region").createOrReplaceTempView("regions")
    out = spark.sql("SELECT r_name, n_name FROM regions JOIN seventh ON r_regionkey = n_regionkey")
    for name in ("seventh", "regions"):
        spark.catalog.dropTempView(name)
    return out


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 12 AND o_totalprice > 1000")
def prepared_params(spark, sf_dir):
    from ..catalog import sql

    return sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :cust AND o_totalprice > :least", {"cust": 12, "least": 1000})


@query("SELECT event_type, date_trunc('hour', ts) AS hour_start, count(*) AS n FROM events GROUP BY ALL")
def agg_hourly_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("event_type", pg.date_trunc("hour", F.col("ts")).alias("hour_start")).agg(F.count(F.lit(1)).alias("n"))
