"""Declared constraints as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their count."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | any_null)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def failing(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; as in SQL, null passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def nulls(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n): how many nulls each column that must not have them has."""
    counts = table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*")


def cascade_delete(child: DataFrame, key: str, gone: DataFrame, parent_key: str, action: str = "cascade", default: Column | None = None) -> DataFrame:
    """child after the parents gone were deleted: rows go (cascade), their key becomes null (set null) or default (set
    default), or nothing changes and a row that refers to one of them is an error (restrict, no action)."""
    keys = gone.select(F.col(parent_key).alias("_g")).distinct()
    if action == "cascade":
        return child.join(keys, F.col(key) == F.col("_g"), "left_anti")
    if action in ("restrict", "no action"):
        if not referenced(gone, parent_key, child, key).isEmpty():
            raise ValueError(f"rows of the child table refer to deleted keys by {key}")
        return child
    if action not in ("set null", "set default"):
        raise ValueError(f"unknown action: {action}")
    new = (F.lit(None) if action == "set null" or default is None else default).cast(child.schema[key].dataType)
    columns = [F.when(F.col("_g").isNull(), F.col(c)).otherwise(new).alias(c) if c == key else F.col(c) for c in child.columns]
    return child.join(keys, F.col(key) == F.col("_g"), "left").select(*columns)


def repeated_values(table: DataFrame, keys: list[str]) -> DataFrame:
    """UNIQUE: keys without a null that occur more than once, with their count; keys with a null never clash."""
    whole = table.dropna(subset=keys)
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def referenced(gone: DataFrame, parent_key: str, child: DataFrame, key: str) -> DataFrame:
    """RESTRICT, NO ACTION: those of the parents gone that can't be deleted, since rows of child refer to them."""
    return gone.join(child.select(F.col(key).alias("_c")), F.col(parent_key) == F.col("_c"), "left_semi")
