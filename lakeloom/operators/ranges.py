"""Range joins as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Pairs of equal keys with left.at < right.at <= left.at + width; right's columns get the prefix right_.

    Both sides are binned by width, and a left row goes to its own bin and the next: an equi-join on keys and bin, of
    which the optimizer may split skewed bins, in place of all pairs of a key. at is an integer.
    """
    r = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns)).withColumn("_bin", F.floor(F.col(f"right_{at}") / width))
    own = F.floor(F.col(at) / width)
    spread = left.withColumn("_bin", F.explode(F.array(own, own + 1)))
    same = [F.col(k) == F.col(f"right_{k}") for k in keys]
    on = (spread["_bin"] == r["_bin"]) & (F.col(f"right_{at}") > F.col(at)) & (F.col(f"right_{at}") <= F.col(at) + width)
    for c in same:
        on = on & c
    return spread.join(r, on).drop("_bin")
