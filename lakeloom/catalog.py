"""Tables of a scale-factor folder as DataFrames and views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The relational tables of a folder, one Parquet table each.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """text over the tables of sf_dir that it names, each a view for as long as it takes to analyse."""
    named = [name for name in TABLES if re.search(rf"\b{name}\b", text, re.IGNORECASE)]
    for name in named:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    try:
        return spark.sql(text, args) if args else spark.sql(text)
    finally:
        for name in named:
            spark.catalog.dropTempView(name)
