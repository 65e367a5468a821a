"""Event streams: windowed counts with a watermark, and the newest version of each key kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of events as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n): final once a window is later than the watermark; the state is one row a window and type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def latest_versions(events: DataFrame, keys: list[str], ts: str, id_: str, path: str, checkpoint: str):
    """Starts a query that appends each batch's newest versions to path; temporal.latest() of that table is the state."""

    def add(batch: DataFrame, _: int) -> None:
        temporal.latest(batch, keys, ts, id_).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
