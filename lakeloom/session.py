"""Session settings that every part of the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def builder(master: str | None = None, **more: str) -> SparkSession.Builder:
    """A builder with SETTINGS; master and further settings are the caller's, as cluster size and memory are."""
    b = SparkSession.builder.appName("lakeloom").config(map=SETTINGS | more)
    return b.master(master) if master else b
