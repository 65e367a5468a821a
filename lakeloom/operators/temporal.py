"""Snapshot reads over versioned rows: key columns, an order (timestamp, id), values and perhaps a tombstone flag.

Versions are ordered by (ts, id), so equal timestamps are told apart by id. Latest and as-of reads are aggregations
that combine before the shuffle; only interval reads sort a key's versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, keys: list[str], ts: str, id_: str, at, deleted: str | None = None) -> DataFrame:
    """Each key's newest version with ts <= at (None: of all); keys whose newest version is a tombstone have none."""
    seen = versions if at is None else versions.where(F.col(ts) <= at)
    rest = [c for c in versions.columns if c not in keys]
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, id_)).alias("_v")).select(*keys, "_v.*")
    return newest.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else newest


def latest(versions: DataFrame, keys: list[str], ts: str, id_: str, deleted: str | None = None) -> DataFrame:
    return as_of(versions, keys, ts, id_, None, deleted)


def validity(versions: DataFrame, keys: list[str], ts: str, id_: str) -> DataFrame:
    """versions with valid_to, the next version's ts; null for the newest."""
    return versions.withColumn("valid_to", F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, id_)))


def committed_after(versions: DataFrame, ts: str, at) -> DataFrame:
    return versions.where(F.col(ts) > at)


def upper_bound(versions: DataFrame, keys: list[str], ts: str, at) -> DataFrame:
    """Each key's smallest ts after at; keys without one are left out."""
    return versions.where(F.col(ts) > at).groupBy(*keys).agg(F.min(ts).alias(ts))


def last_read(versions: DataFrame, reads: DataFrame, keys: list[str], ts: str, id_: str, read_ts: str) -> DataFrame:
    """(keys, ts, id, last_read): for each version the latest read that saw it; null where none did.

    reads: (keys, read_ts). Reads and versions of a key are merged in one sorted pass: each read carries the last
    version before it.
    """
    v = versions.select(*keys, F.col(ts).alias("_at"), F.lit(0).alias("_kind"), F.struct(ts, id_).alias("_v"), F.lit(None).cast(reads.schema[read_ts].dataType).alias("_r"))
    r = reads.select(*keys, F.col(read_ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.col(read_ts).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = v.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_v IS NOT NULL")
    return seen.groupBy(*keys, "_v").agg(F.max("_r").alias("last_read")).select(*keys, F.col(f"_v.{ts}").alias(ts), F.col(f"_v.{id_}").alias(id_), "last_read")


def snapshot_query(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str], str, str, str | None]], at, text: str) -> DataFrame:
    """text, with every table (versions, keys, ts, id, deleted) a view of its rows as of at while it is analysed."""
    for name, (versions, keys, ts, id_, deleted) in tables.items():
        as_of(versions, keys, ts, id_, at, deleted).createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
