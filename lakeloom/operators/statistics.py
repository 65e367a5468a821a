"""Column statistics: exact counts, and sketches where exact ones would shuffle every value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_ERROR, CMS_EPS, CMS_CONFIDENCE, HISTOGRAM_BINS, TOP_K = 0.065, 0.01, 0.99, 100, 10


def analyze(table: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(column_name, n, n_null, null_fraction, n_distinct): one pass over the table; exact counts distinct values whole."""
    columns = columns or table.columns
    distinct = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, HLL_ERROR)
    parts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), distinct(F.col(c)).alias(f"d{i}"))]
    one = table.agg(F.count(F.lit(1)).alias("n"), *parts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n"), (F.col("n") - F.col(f"n{i}")).alias("n_null"), ((F.col("n") - F.col(f"n{i}")) / F.nullif(F.col("n"), F.lit(0))).alias("null_fraction"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def top_values(table: DataFrame, column: str, k: int = TOP_K) -> DataFrame:
    """The k most frequent values; ties by value."""
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def equi_height(table: DataFrame, column: str, bins: int, accuracy: int = 0) -> DataFrame:
    """(bound, value): the bounds of bins of equal count, as percentiles.

    Exact ones need a count of each distinct value in one task, so they are for columns of few values; with an accuracy
    (1 over the greatest error in rank) they are approximate, from summaries that merge.
    """
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    values = table.agg((F.percentile_approx(column, shares, accuracy) if accuracy else F.percentile(column, shares)).alias("v"))
    return values.select(F.posexplode("v").alias("bound", "value"))


def sketches(table: DataFrame, column: str) -> DataFrame:
    """One row: approximate distinct count, count-min sketch, histogram and frequent values of a column."""
    return table.agg(
        F.approx_count_distinct(column, HLL_ERROR).alias("n_distinct"),
        F.count_min_sketch(F.col(column), F.lit(CMS_EPS), F.lit(CMS_CONFIDENCE), F.lit(1)).alias("count_min"),
        F.histogram_numeric(F.col(column).cast("double"), F.lit(HISTOGRAM_BINS)).alias("histogram"),
    )


def zone_map(table: DataFrame, zone: str, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column by zone."""
    return table.groupBy(zone).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def sampled(table: DataFrame, key: str, rows: int, seed: int = 1) -> DataFrame:
    """rows rows, the same on every run: those of the smallest hash of seed and key."""
    return table.orderBy(_place(seed, key), key).limit(rows)


def join_sample(left: DataFrame, right: DataFrame, on: str, key: str, rows: int, seed: int = 1) -> DataFrame:
    """A sample of the join of left and right: rows rows of left that have a match (sampled() by key), with all they meet."""
    return sampled(left.join(right.select(on), on, "left_semi"), key, rows, seed).join(right, on)


def _place(seed: int, key: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def _cells(value, rows: int, width: int):
    cell = lambda i: F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), value), F.lit(width)).cast("int").alias("cell"))
    return F.array(*map(cell, range(rows)))


def count_min(table: DataFrame, column: str, eps: float = CMS_EPS, confidence: float = CMS_CONFIDENCE) -> DataFrame:
    """(row, cell, n): a count-min sketch as a table of counters, at most ln(1 / (1 - confidence)) * e / eps of them.

    Sketches of parts of a table add up. Nulls aren't counted.
    """
    rows, width = math.ceil(math.log(1 / (1 - confidence))), math.ceil(math.e / eps)
    cells = table.where(F.col(column).isNotNull()).select(F.explode(_cells(F.col(column), rows, width)).alias("c"))
    return cells.groupBy("c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def frequency(sketch: DataFrame, values: DataFrame, column: str, eps: float = CMS_EPS, confidence: float = CMS_CONFIDENCE) -> DataFrame:
    """values' distinct column with estimate, read from count_min(): never too low, and with the confidence at most eps
    times all counted values too high. eps and confidence are the sketch's."""
    rows, width = math.ceil(math.log(1 / (1 - confidence))), math.ceil(math.e / eps)
    asked = values.select(column).dropna().distinct().withColumn("_c", F.explode(_cells(F.col(column), rows, width)))
    met = asked.join(sketch, (F.col("_c.row") == F.col("row")) & (F.col("_c.cell") == F.col("cell")), "left")
    return met.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
