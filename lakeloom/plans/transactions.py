"""The read patterns and changes of the transactional workloads, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import load
from ..operators import dml
from .registry import query, sql_query

# Order entry: stock level, order status, delivery, payment, new order.
sql_query("tpcc_stock_level", """
    WITH recent AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20),
         stock AS (SELECT l_partkey AS part, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_partkey)
    SELECT COUNT(DISTINCT l_partkey) AS low_stock FROM lineitem JOIN recent ON l_orderkey = o_orderkey JOIN stock ON part = l_partkey WHERE quantity < 800""")
sql_query("tpcc_order_status", """
    WITH last_order AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 42 ORDER BY o_orderkey DESC LIMIT 1)
    SELECT o_orderkey, o_orderdate, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM last_order JOIN lineitem ON l_orderkey = o_orderkey""")
sql_query("tpcc_delivery_min", "SELECT o_orderpriority, MIN(o_orderkey) AS oldest FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
sql_query("tpcc_payment_customer", """
    SELECT nation, c_custkey FROM (SELECT c_nationkey AS nation, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r,
           COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_mktsegment LIKE 'B%') t WHERE r = CAST(CEIL(n / 2.0) AS BIGINT)""")
sql_query("tpcc_new_order_reads", """
    SELECT c_custkey, c_acctbal, p_partkey, p_retailprice, s_suppkey FROM customer, part, supplier WHERE c_custkey = 7 AND p_partkey IN (1, 5, 9) AND s_suppkey = p_partkey % 10""")
# Flights: nearby places by distance, a join with an OR list and a limit, open seats and their price.
sql_query("seats_find_flights_shape", """
    SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE (c_nationkey = 1 OR c_nationkey = 4 OR c_nationkey = 9) AND o_orderdate BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1999-01-01 00:00:00'
    ORDER BY o_orderdate, o_orderkey LIMIT 25""")
sql_query("seats_nearby", "SELECT b.s_suppkey, abs(a.s_acctbal - b.s_acctbal) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey = 3 AND abs(a.s_acctbal - b.s_acctbal) < 900 ORDER BY distance, b.s_suppkey")
# Auctions: unions of ordered top lists, the greatest key, due items.
sql_query("auction_user_info", """
    SELECT 'dear' AS kind, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_custkey < 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) a
    UNION ALL SELECT 'new' AS kind, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_custkey < 100 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25) b""")
sql_query("auction_max_id", "SELECT o_custkey, MAX(o_orderkey) AS last_id FROM orders WHERE o_custkey IN (3, 30, 300) GROUP BY o_custkey")
sql_query("auction_due_items", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1999-06-01 00:00:00' AND TIMESTAMP '1999-09-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 100")
sql_query("auction_purchase_join", """
    SELECT c_name, p_name, s_name, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = 100""")
# Key ranges, points and scans.
sql_query("rw_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 500 AND 620 AND o_totalprice > 50000")
sql_query("rw_wrapping_range", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 14950 OR o_orderkey <= 30")
sql_query("kv_point_get", "SELECT concat('order:', CAST(o_orderkey AS VARCHAR(20))) AS key_, o_orderstatus AS val_ FROM orders WHERE o_orderkey = 1234")
sql_query("ycsb_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 3000 ORDER BY o_orderkey LIMIT 100")
sql_query("retwis_timeline", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' AND user_id IN (1, 7, 20) ORDER BY ts DESC, event_id DESC LIMIT 50")


@query("""SELECT s AS seat, CAST(100 + 100 * (1 - (150 - taken) / 150) AS DOUBLE) AS price FROM (SELECT unnest(range(1, 151)) AS s),
              (SELECT count(DISTINCT l_partkey % 150 + 1) AS taken FROM lineitem WHERE l_orderkey < 20) WHERE s NOT IN (SELECT l_partkey % 150 + 1 FROM lineitem WHERE l_orderkey < 20)""")
def seats_open_seats(spark, sf_dir):
    taken = load(spark, sf_dir, "lineitem").where("l_orderkey < 20").select((F.col("l_partkey") % 150 + 1).alias("seat")).distinct()
    count = taken.agg(F.count(F.lit(1)).alias("n"))
    seats = spark.range(1, 151).withColumnRenamed("id", "seat").join(taken, "seat", "left_anti")
    return seats.crossJoin(F.broadcast(count)).select("seat", (100 + 100 * (1 - (150 - F.col("n")) / 150)).alias("price"))  # one row is broadcast


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 997 = 0 AND NOT (o_orderstatus = 'P')")
def seats_delete_reservation(spark, sf_dir):
    orders = dml.delete(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P").where("o_orderkey % 997 = 0")
    return orders.join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


def _accounts(spark, sf_dir):
    """Savings and checking balances: a customer's balance, and the hundredth of their orders' price."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("saving"))
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 100).alias("checking"))
    return c.join(o, "id")


_ACCOUNTS = "SELECT c_custkey AS id, c_acctbal AS saving, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100 AS checking FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal"


@query(f"SELECT id, saving + checking AS balance FROM ({_ACCOUNTS}) a")
def smallbank_balance(spark, sf_dir):
    return _accounts(spark, sf_dir).select("id", (F.col("saving") + F.col("checking")).alias("balance"))


@query(f"SELECT id, saving, checking - CASE WHEN saving + checking < 15000 THEN 15001 ELSE 15000 END AS checking FROM ({_ACCOUNTS}) a")
def smallbank_write_check(spark, sf_dir):
    amount = F.when(F.col("saving") + F.col("checking") < 15000, 15001).otherwise(15000)
    return dml.update(_accounts(spark, sf_dir), F.lit(True), {"checking": F.col("checking") - amount}).select("id", "saving", "checking")


@query(f"""SELECT id, CASE WHEN id = 1 THEN 0 ELSE saving END AS saving, CASE WHEN id = 1 THEN 0 WHEN id = 2 THEN checking + (SELECT saving + checking FROM ({_ACCOUNTS}) b WHERE id = 1) ELSE checking END AS checking FROM ({_ACCOUNTS}) a""")
def smallbank_amalgamate(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    moved = a.where("id = 1").select((F.col("saving") + F.col("checking")).alias("moved")).groupBy().agg(F.max("moved").alias("moved"))
    b = a.crossJoin(F.broadcast(moved))  # one row is broadcast
    b = dml.update(b, F.col("id") == 2, {"checking": F.col("checking") + F.col("moved")})
    return dml.update(b, F.col("id") == 1, {"saving": F.lit(0.0), "checking": F.lit(0.0)}).drop("moved")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r <= 3")
def topn_per_group(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "ts")
