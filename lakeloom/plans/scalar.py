"""Scalar functions over real columns and over edge values, and user-defined functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import load, sql
from ..functions import postgres as pg
from .registry import query, sql_query

sql_query("fn_string", """
    SELECT p_partkey, ascii(p_name) AS first_code, chr(65 + p_size % 26) AS letter, CAST(char_length(p_name) AS INT) AS chars, concat(p_name, p_type) AS joined,
           p_brand || '/' || p_type AS slashed, repeat('ab', p_size % 4) AS repeated, replace(p_name, 'bolt', 'nut') AS replaced,
           upper(p_name) AS up, lower(p_type) AS low, substring(p_name, 2, 3) AS middle
    FROM part""")
sql_query("fn_math", """
    SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c,
           sqrt(abs(c_acctbal)) AS root, c_custkey % 7 AS m, -c_custkey AS negative, CAST(round(c_acctbal / 3) AS BIGINT) AS near
    FROM customer""")
sql_query("fn_case", """
    SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS bucket,
           CASE WHEN NULLIF(p_size, 7) > 3 THEN 1 END AS no_else, COALESCE(NULLIF(p_brand, 'Brand#1'), 'none') AS brand
    FROM part""")
sql_query("fn_cast", """
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(substring(o_orderpriority, 1, 1) AS INT) AS level,
           CAST(o_orderkey AS DOUBLE) AS key_double, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 2 AS BOOLEAN) AS odd
    FROM orders""")
sql_query("fn_extract_year", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2")
sql_query("fn_distinct_from", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS DISTINCT FROM NULLIF(n_nationkey % 5, 2) AS differ FROM nation")
sql_query("fn_int_div_mod",
    "SELECT a, b, a div b AS quotient, a % b AS remainder FROM (VALUES (7, 2), (-7, 2), (7, -2), (-7, -3), (0, 5)) t(a, b)",
    "SELECT a, b, CAST(a // b AS BIGINT) AS quotient, a % b AS remainder FROM (VALUES (7, 2), (-7, 2), (7, -2), (-7, -3), (0, 5)) t(a, b)")
sql_query("fn_greatest_least", "SELECT p_partkey, greatest(p_size, 20) AS high, least(p_size, 20) AS low FROM part")


@query("""SELECT s, trim(s, ' x') AS both_ends, ltrim(s, ' x') AS left_end, rtrim(s, ' x') AS right_end, trim(s) AS plain, CAST(length(s) AS INT) AS n,
              CAST(strlen(s) AS INT) AS bytes FROM (VALUES (''), ('a'), ('ABC'), ('  x '), ('xx y x'), ('é%b'), (NULL)) t(s)""")
def fn_trim(spark, sf_dir):
    t = spark.createDataFrame([("",), ("a",), ("ABC",), ("  x ",), ("xx y x",), ("é%b",), (None,)], "s string")
    s = F.col("s")
    return t.select("s", pg.btrim(s, " x").alias("both_ends"), pg.ltrim(s, " x").alias("left_end"), pg.rtrim(s, " x").alias("right_end"), pg.btrim(s).alias("plain"), F.length(s).alias("n"), F.octet_length(s).alias("bytes"))


@query("""SELECT f, n, CASE WHEN n >= 0 THEN substring('hello', greatest(f, 1), greatest(f + n - greatest(f, 1), 0)) END AS part
          FROM (SELECT unnest(range(-2, 8)) AS f), (SELECT unnest(range(-1, 5)) AS n)""")
def fn_substr_edges(spark, sf_dir):
    return spark.range(-2, 8).withColumnRenamed("id", "f").crossJoin(spark.range(-1, 5).withColumnRenamed("id", "n")).select("f", "n", pg.substr(F.lit("hello"), F.col("f").cast("int"), F.col("n").cast("int")).alias("part"))


_PARTS = ("century", "day", "decade", "dow", "doy", "hour", "microsecond", "millennium", "millisecond", "minute", "month", "quarter", "second", "week", "year")


@query("SELECT event_id, " + ", ".join(f"CAST(date_part('{p}', ts) AS DOUBLE) AS {p}_part" for p in _PARTS if p not in ("second", "millisecond", "microsecond", "century", "millennium"))
       + ", second(ts) + (date_part('microsecond', ts) % 1000000) / 1000000 AS second_part, CAST(date_part('microsecond', ts) AS DOUBLE) AS microsecond_part, date_part('microsecond', ts) / 1000 AS millisecond_part,"
       + " CAST(ceil(year(ts) / 100) AS DOUBLE) AS century_part, CAST(ceil(year(ts) / 1000) AS DOUBLE) AS millennium_part FROM events")
def fn_date_part(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", *(pg.date_part(p, F.col("ts")).alias(f"{p}_part") for p in _PARTS))


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, date_trunc('week', o_orderdate) AS week_start, date_trunc('quarter', o_orderdate) AS quarter_start,
              date_trunc('year', o_orderdate) AS year_start, make_timestamp(year(o_orderdate) - year(o_orderdate) % 10, 1, 1, 0, 0, 0) AS decade_start,
              make_timestamp(year(o_orderdate) - year(o_orderdate) % 100 + 1, 1, 1, 0, 0, 0) AS century_start,
              make_timestamp(year(o_orderdate) - year(o_orderdate) % 1000 + 1, 1, 1, 0, 0, 0) AS millennium_start, CAST(NULL AS TIMESTAMP) AS unknown_start FROM orders""")
def fn_date_trunc(spark, sf_dir):
    parts = ("month", "week", "quarter", "year", "decade", "century", "millennium", "unknown")
    return load(spark, sf_dir, "orders").select("o_orderkey", *(pg.date_trunc(p, F.col("o_orderdate")).alias(f"{p}_start") for p in parts))


_FINE = ("day", "hour", "minute", "second", "millisecond", "microsecond")


@query("SELECT event_id, " + ", ".join(f"date_trunc('{p}', ts + INTERVAL '1234567' MICROSECOND) AS {p}_start" for p in _FINE) + " FROM events")
def fn_date_trunc_fine(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL '1.234567' SECOND")).alias("ts"))
    return e.select("event_id", *(pg.date_trunc(p, F.col("ts")).alias(f"{p}_start") for p in _FINE))


sql_query("fn_compare_text_number", "SELECT o_orderkey FROM orders WHERE substring(o_orderpriority, 1, 1) = 3 AND o_orderkey < 2000",
          "SELECT o_orderkey FROM orders WHERE CAST(substring(o_orderpriority, 1, 1) AS INT) = 3 AND o_orderkey < 2000")
sql_query("fn_identifiers_fold", "SELECT O_OrderKey AS o_orderkey, Big.N_NAME AS n_name FROM ORDERS JOIN (SELECT N_NationKey, n_name FROM Nation) BIG ON o_custkey % 25 = big.n_nationkey WHERE o_ORDERKEY < 50")
sql_query("fn_parse_text",
    "SELECT s, try_cast(s AS BOOLEAN) AS b, try_cast(s AS TINYINT) AS t, try_cast(s AS BIGINT) AS n, try_cast(s AS DOUBLE) AS d FROM (VALUES ('true'), ('f'), ('12'), ('-128'), ('300'), ('1.5'), ('abc'), (''), (NULL)) v(s)",
    "SELECT s, CASE WHEN s IN ('true', 'f') THEN TRY_CAST(s AS BOOLEAN) END AS b, CASE WHEN s NOT LIKE '%.%' THEN TRY_CAST(s AS TINYINT) END AS t, CASE WHEN s NOT LIKE '%.%' THEN TRY_CAST(s AS BIGINT) END AS n, TRY_CAST(s AS DOUBLE) AS d FROM (VALUES ('true'), ('f'), ('12'), ('-128'), ('300'), ('1.5'), ('abc'), (''), (NULL)) v(s)")


@query("""SELECT s, TRY_CAST(replace(s, '/', '-') AS DATE) AS d, CAST(TRY_CAST(replace(s, '/', '-') AS DATE) - DATE '1970-01-01' AS INT) + 2440588 AS julian
          FROM (VALUES ('2024-02-29'), ('2023-02-29'), ('1999/12/31'), ('2020-13-01'), (NULL)) t(s)""")
def fn_date_parse(spark, sf_dir):
    t = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("1999/12/31",), ("2020-13-01",), (None,)], "s string")
    d = pg.to_date(F.col("s"))
    return t.select("s", d.alias("d"), pg.julian_day(d).alias("julian"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48")
def udf_sql_scalar(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return sql(spark, sf_dir, "SELECT l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount) AS net FROM lineitem WHERE l_quantity > 48")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * 0.5 WHEN p_size > 20 THEN p_retailprice * (1 - p_size / 100.0::DOUBLE) ELSE p_retailprice END AS price FROM part""")
def udf_sql_branches(spark, sf_dir):
    """IF, ELSIF and ELSE over arguments."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cut_price(price DOUBLE, size INT) RETURNS DOUBLE RETURN CASE WHEN size > 40 THEN price * 0.5D WHEN size > 20 THEN price * (1 - size / 100.0D) ELSE price END")
    return sql(spark, sf_dir, "SELECT p_partkey, cut_price(p_retailprice, p_size) AS price FROM part")


@query("""SELECT p_partkey, CAST(f AS BIGINT) AS factorial FROM part JOIN (SELECT n, CAST(factorial(CAST(n AS INT)) AS BIGINT) AS f FROM (SELECT unnest(range(0, 11)) AS n)) t ON n = p_size % 11""")
def udf_python_recursive(spark, sf_dir):
    def factorial(n: int) -> int:
        return 1 if n < 2 else n * factorial(n - 1)

    @F.pandas_udf("long")
    def many(n):
        return n.map({k: factorial(int(k)) for k in n.unique()})

    return load(spark, sf_dir, "part").select("p_partkey", many(F.col("p_size") % 11).alias("factorial"))
