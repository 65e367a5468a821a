"""Files and tables written and read back: COPY to and from delimited files, blank-padded files, managed tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..catalog import load
from ..sources import delimited
from .registry import query


def _place(spark, name: str) -> str:
    """A new folder in the warehouse, which the driver and all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lakeloom/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def copy_to_and_from_csv(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    c = c.select("c_custkey", "c_name", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    path = _place(spark, "csv")
    delimited.write_csv(c, path, escape='"')
    return delimited.read_csv(spark, path, c.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_blank_padded_tbl(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    path = _place(spark, "tbl")
    n.select(F.concat_ws("|", "n_nationkey", F.rpad("n_name", 25, " "), "n_regionkey")).write.text(path)
    return delimited.read_tbl(spark, path, n.schema)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL VALUES (CAST(-1 AS BIGINT), 'X')")
def ddl_create_insert_select(spark, sf_dir):
    """A managed table in a schema of its own; the caller drops it when the rows are read (drop_made())."""
    schema = f"lakeloom_{uuid.uuid4().hex}"
    name = f"{schema}.orders"
    spark.sql(f"CREATE SCHEMA {schema}")
    spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, o_orderstatus STRING) USING parquet")
    load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus").write.insertInto(name)
    spark.sql(f"INSERT INTO {name} (o_orderkey, o_orderstatus) VALUES (-1, 'X')")
    return spark.table(name)


def drop_made(spark) -> list[str]:
    """Drops the schemas that ddl_create_insert_select made, with their tables and files; their names."""
    made = [d.name for d in spark.catalog.listDatabases("lakeloom_*")]
    for name in made:
        spark.sql(f"DROP SCHEMA {name} CASCADE")
    return made


@query("SELECT n_regionkey AS n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 10 GROUP BY n_regionkey")
def ddl_truncate_drop(spark, sf_dir):
    """A table that is filled, emptied, filled again, read and dropped: what was read is cut by a collect of its few groups."""
    schema = f"lakeloom_{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "nation")
    spark.sql(f"CREATE SCHEMA {schema}")
    rows.write.saveAsTable(f"{schema}.nation")
    spark.sql(f"TRUNCATE TABLE {schema}.nation")
    rows.where("n_nationkey < 10").write.insertInto(f"{schema}.nation")
    counts = spark.table(f"{schema}.nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    out = spark.createDataFrame(counts.collect(), counts.schema)  # a row a region
    spark.sql(f"DROP TABLE {schema}.nation")
    spark.sql(f"DROP SCHEMA {schema}")
    return out


@query("SELECT 'spark.sql.shuffle.partitions' AS setting, '17' AS value, true AS planned")
def session_set_and_explain(spark, sf_dir):
    """SET and EXPLAIN: a setting as the session then has it, and a plan as text; the setting is put back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.sql(f"SET {key} = 17")
    value = spark.conf.get(key)
    spark.conf.set(key, before)
    load(spark, sf_dir, "nation").createOrReplaceTempView("explained")
    plan = spark.sql("EXPLAIN FORMATTED SELECT n_regionkey, count(*) FROM explained GROUP BY n_regionkey").first()[0]
    spark.catalog.dropTempView("explained")
    return spark.createDataFrame([(key, value, "HashAggregate" in plan)], "setting string, value string, planned boolean")


@query("SELECT s_suppkey, s_name || '~;\\\"' AS s_name, s_acctbal FROM supplier")
def copy_with_own_delimiters(spark, sf_dir):
    """Own delimiter and quote, and backslashes as escapes; values hold all three."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit('~;\\"')).alias("s_name"), "s_acctbal")
    path = _place(spark, "csv")
    delimited.write_csv(s, path, delimiter=";", quote="~")
    return delimited.read_csv(spark, path, s.schema, delimiter=";", quote="~", escape="\\")


@query("SELECT p_partkey AS col1, p_type AS col2, p_retailprice AS col3 FROM part")
def read_described_table(spark, sf_dir):
    """A table described by JSON, its data a CSV file whose first line holds names and types."""
    folder = _place(spark, "described")
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("col1"), F.col("p_type").alias("col2"), F.col("p_retailprice").alias("col3"))
    rows.withColumnsRenamed({"col1": "col1 bigint", "col2": "col2 text", "col3": "col3 double"}).write.csv(f"{folder}/rows", header=True, escape='"')
    described = {"table1": {"table_name": "table1", "column_names_and_types": [["col1", "BIGINT"], ["col2", "VARCHAR(20)"], ["col3", "DOUBLE"]], "primary_key_col_idx": [0], "indexes": {}, "row_data_path": "/rows"}}
    spark.createDataFrame([(json.dumps(described),)], "value string").write.text(f"{folder}/schema")
    return delimited.read_described(spark, f"{folder}/schema/*.txt", "table1", folder)


@query("SELECT 'orders' AS table_name, column_name, data_type FROM (VALUES ('o_custkey', 'bigint'), ('o_orderdate', 'timestamp_ntz'), ('o_orderkey', 'bigint'), ('o_orderpriority', 'string'), ('o_orderstatus', 'string'), ('o_totalprice', 'double')) t(column_name, data_type)")
def catalog_columns(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("listed_orders")
    rows = [("orders", c.name, c.dataType) for c in spark.catalog.listColumns("listed_orders")]
    spark.catalog.dropTempView("listed_orders")
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
