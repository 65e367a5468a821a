"""Data changes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """table and rows; columns that rows lack get their default, or null."""
    lacking = {c: (defaults or {}).get(c, F.lit(None)).cast(table.schema[c].dataType) for c in table.columns if c not in rows.columns}
    return table.unionByName(rows.withColumns(lacking).select(*table.columns) if lacking else rows.select(*table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those of rows whose keys it doesn't have; of rows with equal keys one, the least by all columns."""
    fresh = rows.select(*table.columns).join(table.select(*keys), keys, "left_anti")
    rest = [c for c in table.columns if c not in keys]
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else fresh.distinct()
    return table.unionByName(one)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """table with values set where the condition is true; all values see the row as it was."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def update_from(table: DataFrame, changes: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """table with values set in the rows whose keys changes has; values may use changes' other columns.

    changes has a row a key at most (sum requests up first), and no column of table but the keys.
    """
    hit = "_hit"
    while hit in table.columns or hit in changes.columns:
        hit += "_"
    joined = table.join(changes.withColumn(hit, F.lit(True)), keys, "left")
    return update(joined, F.col(hit), values).select(*table.columns)


def delete_from(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys gone hasn't; rows of a null key stay."""
    return table.join(gone.select(*keys), keys, "left_anti")


def truncate(table: DataFrame) -> DataFrame:
    """No rows of the same columns."""
    return table.where(F.lit(False))


def delete(table: DataFrame, where: Column) -> DataFrame:
    """The rows for which the condition isn't true."""
    return table.where(~F.coalesce(where, F.lit(False)))


def merge_delta(table: DataFrame, delta: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """table after delta, rows with its columns, an order and a tombstone flag: a key's last change holds."""
    rest = [c for c in table.columns if c not in keys]
    last = delta.groupBy(*keys).agg(F.max_by(F.struct(*rest, deleted), F.struct(*order)).alias("_d"))
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.where(~F.coalesce(F.col(f"_d.{deleted}"), F.lit(False))).select(*keys, *(F.col(f"_d.{c}").alias(c) for c in rest)).select(*table.columns))
