"""The 22 analytic queries over order processing, on the driver's tables.

Money is summed as decimals, so that sums are exact and don't depend on the order of rows. An order's line stands for
an order line, (part, supplier) pairs of lines for the stock, open orders for new orders.
"""

from __future__ import annotations

from .registry import sql_query

STOCK = "stock AS (SELECT l_partkey AS st_part, l_suppkey AS st_supp, CAST(SUM(l_quantity) AS BIGINT) AS st_quantity, COUNT(*) AS st_orders FROM lineitem GROUP BY l_partkey, l_suppkey)"


def money(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


AMOUNT = money("l_extendedprice")

sql_query("ch_q01", f"""
    SELECT l_linenumber, {money("l_quantity")} AS sum_qty, {AMOUNT} AS sum_amount,
           {money("l_quantity")} / COUNT(l_quantity) AS avg_qty, {AMOUNT} / COUNT(l_extendedprice) AS avg_amount, COUNT(*) AS count_order
    FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-02 00:00:00'
    GROUP BY l_linenumber ORDER BY l_linenumber""")

sql_query("ch_q02", f"""
    WITH {STOCK},
         local AS (SELECT st_part, st_supp, st_quantity FROM stock JOIN supplier ON st_supp = s_suppkey
                   JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'EUROP%'),
         least_stock AS (SELECT st_part AS m_part, MIN(st_quantity) AS m_quantity FROM local GROUP BY st_part)
    SELECT s_suppkey, s_name, n_name, p_partkey, p_name, st_quantity
    FROM part JOIN local ON p_partkey = st_part JOIN least_stock ON st_part = m_part AND st_quantity = m_quantity
         JOIN supplier ON st_supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_type LIKE 'PR%' AND p_name LIKE '%bolt'
    ORDER BY n_name, s_name, p_partkey""")

sql_query("ch_q03", f"""
    SELECT l_orderkey, o_custkey, {AMOUNT} AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment LIKE 'A%' AND o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1999-01-02 00:00:00'
    GROUP BY l_orderkey, o_custkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey""")

sql_query("ch_q04", """
    WITH sized AS (SELECT l_orderkey, COUNT(*) AS ol_cnt FROM lineitem GROUP BY l_orderkey)
    SELECT ol_cnt, COUNT(*) AS order_count
    FROM orders o JOIN sized z ON o.o_orderkey = z.l_orderkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-02 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-02 00:00:00'
      AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate + INTERVAL '60' DAY)
    GROUP BY ol_cnt ORDER BY ol_cnt""")

sql_query("ch_q05", f"""
    SELECT n_name, {AMOUNT} AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
         JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-02 00:00:00'
      AND ascii(substring(c_mktsegment, 1, 1)) % 5 = n_nationkey % 5
    GROUP BY n_name ORDER BY revenue DESC""")

sql_query("ch_q06", f"""
    SELECT {AMOUNT} AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '2000-01-01 00:00:00' AND l_quantity BETWEEN 1 AND 24""")

sql_query("ch_q07", f"""
    SELECT s_nationkey AS supp_nation, substring(n2.n_name, 1, 8) AS cust_nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS l_year, {AMOUNT} AS revenue
    FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
         JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
    WHERE ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))
      AND l_shipdate BETWEEN TIMESTAMP '1996-01-02 00:00:00' AND TIMESTAMP '2001-01-02 00:00:00'
    GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")

sql_query("ch_q08", f"""
    SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS l_year,
           {money("CASE WHEN n2.n_name = 'NATION_7' THEN l_extendedprice ELSE 0 END")} / {AMOUNT} AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
         JOIN nation n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = 'EUROPE' AND p_name LIKE '%bolt' AND l_partkey < 100000
    GROUP BY l_year ORDER BY l_year""")

sql_query("ch_q09", f"""
    SELECT n_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS l_year, {AMOUNT} AS sum_profit
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
         JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_name LIKE '%bolt%' GROUP BY n_name, l_year ORDER BY n_name, l_year DESC""")

sql_query("ch_q10", f"""
    SELECT c_custkey, c_name, {AMOUNT} AS revenue, c_mktsegment, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
         JOIN nation ON n_nationkey = ascii(substring(c_mktsegment, 1, 1)) % 25
    WHERE o_orderdate >= TIMESTAMP '1996-01-02 00:00:00' AND o_orderdate <= l_shipdate
    GROUP BY c_custkey, c_name, c_mktsegment, n_name ORDER BY revenue DESC, c_custkey""")

sql_query("ch_q11", f"""
    WITH {STOCK},
         local AS (SELECT st_part, st_orders FROM stock JOIN supplier ON st_supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
    SELECT st_part, CAST(SUM(st_orders) AS BIGINT) AS order_count FROM local
    GROUP BY st_part HAVING SUM(st_orders) > (SELECT SUM(st_orders) * 0.001 FROM local) ORDER BY order_count DESC, st_part""")

sql_query("ch_q12", """
    WITH sized AS (SELECT l_orderkey AS z_orderkey, COUNT(*) AS ol_cnt FROM lineitem GROUP BY l_orderkey)
    SELECT ol_cnt, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
           CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN sized ON o_orderkey = z_orderkey
    WHERE o_orderdate <= l_shipdate AND l_shipdate < TIMESTAMP '2000-01-01 00:00:00'
    GROUP BY ol_cnt ORDER BY ol_cnt""")

sql_query("ch_q13", """
    SELECT c_count, COUNT(*) AS custdist
    FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000
          GROUP BY c_custkey) c_orders
    GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")

sql_query("ch_q14", f"""
    SELECT 100.00 * {money("CASE WHEN p_type LIKE 'PR%' THEN l_extendedprice ELSE 0 END")} / (1 + {AMOUNT}) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1997-01-02 00:00:00' AND l_shipdate < TIMESTAMP '2000-01-02 00:00:00'""",
    f"""
    SELECT CAST(100 AS DOUBLE) * {money("CASE WHEN p_type LIKE 'PR%' THEN l_extendedprice ELSE 0 END")} / (1 + {AMOUNT}) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1997-01-02 00:00:00' AND l_shipdate < TIMESTAMP '2000-01-02 00:00:00'""")

sql_query("ch_q15", f"""
    WITH revenue AS (SELECT l_suppkey AS supplier_no, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem
                     WHERE l_shipdate >= TIMESTAMP '1997-01-02 00:00:00' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, CAST(total AS DOUBLE) AS total_revenue
    FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT MAX(total) FROM revenue) ORDER BY s_suppkey""")

sql_query("ch_q16", f"""
    WITH {STOCK}
    SELECT p_name, substring(p_type, 1, 3) AS brand, p_size, COUNT(DISTINCT st_supp % 1000) AS supplier_cnt
    FROM stock JOIN part ON p_partkey = st_part
    WHERE p_type NOT LIKE 'PR%' AND st_supp NOT IN (SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7')
    GROUP BY p_name, brand, p_size ORDER BY supplier_cnt DESC, p_name, brand, p_size""")

sql_query("ch_q17", f"""
    SELECT {AMOUNT} / 2.0 AS avg_yearly
    FROM lineitem JOIN (SELECT p_partkey, {money("l_quantity")} / COUNT(l_quantity) AS a FROM part JOIN lineitem ON l_partkey = p_partkey
                        WHERE p_name LIKE '%bolt' GROUP BY p_partkey) t ON l_partkey = t.p_partkey
    WHERE l_quantity < t.a""")

sql_query("ch_q18", f"""
    WITH large AS (SELECT l_orderkey, {money("l_extendedprice")} AS amount, {money("l_quantity")} AS quantity FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, amount, quantity
    FROM large JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY amount DESC, o_orderkey""", f"""
    SELECT c_name, c_custkey, o_orderkey, o_orderdate, {money("l_extendedprice")} AS amount, {money("l_quantity")} AS quantity
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate HAVING SUM(l_quantity) > 200 ORDER BY amount DESC, o_orderkey""")

sql_query("ch_q19", f"""
    SELECT {AMOUNT} AS revenue FROM lineitem, part
    WHERE (l_partkey = p_partkey AND p_type LIKE '%O' AND l_quantity BETWEEN 1 AND 10 AND p_retailprice BETWEEN 900 AND 950 AND p_size IN (1, 2, 3, 5, 8))
       OR (l_partkey = p_partkey AND p_type LIKE 'S%' AND l_quantity BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 960 AND p_size IN (2, 4, 6))
       OR (l_partkey = p_partkey AND p_type LIKE 'LARGE%' AND l_quantity BETWEEN 20 AND 30 AND p_retailprice BETWEEN 900 AND 999 AND p_size IN (1, 3, 5, 7))""")

sql_query("ch_q20", f"""
    WITH {STOCK}
    SELECT s_name, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE s_suppkey IN (SELECT (st_part * st_supp) % (SELECT COUNT(*) FROM supplier) FROM stock JOIN lineitem ON l_partkey = st_part
                        WHERE st_part IN (SELECT p_partkey FROM part WHERE p_name LIKE 'b%') AND l_shipdate > TIMESTAMP '1998-05-23 12:00:00'
                        GROUP BY st_part, st_supp, st_quantity HAVING 2 * st_quantity > SUM(l_quantity) / 10)
      AND n_name LIKE 'NATION_1%'
    ORDER BY s_name""")

sql_query("ch_q21", """
    SELECT s_name, COUNT(*) AS numwait
    FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
    WHERE l1.l_shipdate > o_orderdate + INTERVAL '30' DAY AND n_name = 'NATION_7'
      AND NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND l2.l_shipdate > l1.l_shipdate)
    GROUP BY s_name ORDER BY numwait DESC, s_name""")

sql_query("ch_q22", """
    SELECT substring(c_mktsegment, 1, 1) AS country, COUNT(*) AS numcust, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS totacctbal
    FROM customer
    WHERE substring(c_name, length(c_name), 1) IN ('1', '2', '3', '4', '5', '6', '7')
      AND c_acctbal > (SELECT CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000)
    GROUP BY substring(c_mktsegment, 1, 1) ORDER BY country""")
