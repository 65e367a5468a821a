"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is min(cap, exp(lambda * x)), x being its size over its source's mean size: the rates of least
relative entropy that meet the source's token target under the cap. The dual in lambda is convex and separate for each
source; Newton steps, kept inside a shrinking bracket, solve it for all sources at once, each step one aggregation of
the (source, size) histogram. The rates are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, stored, table, unused

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
STEPS_PER_CUT, MAX_STEPS, TOLERANCE = 6, 120, 1e-9
#: Documents of a source that are rounded together.
BUCKET_DOCS = 1000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target) from rows (source, size, docs): one row per source.

    The sources by code point, null last, take the weights in turn and share `share` of all sizes. A target stops at
    cap times its source's size and the others share the excess by weight: the level at which min(cap * size,
    weight * level) sums to the whole. The two windows run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (order % len(weights) + 1).cast("int")))
    s = s.withColumn("ceiling", F.col("source_size") * float(cap))
    every = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stopped = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * float(share) - stopped) / open_weight)
    first_open = F.min(F.when(F.col("weight") * F.col("level") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    target = F.least("ceiling", F.coalesce(F.col("weight") * first_open["level"], F.col("ceiling")))
    return s.select("source", "source_size", "docs", F.greatest(target, F.lit(0.0)).alias("target"))


def _tilt(lam, x, cap: float):
    return F.when(lam * x >= F.log(F.lit(float(cap))), float(cap)).otherwise(F.exp(F.greatest(lam * x, F.lit(-700.0))))


def solve(histogram: DataFrame, open_sources: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, lam): the dual solution for sources with 0 < target < cap * size, from rows (source, size, docs).

    A RuntimeError is raised if MAX_STEPS steps leave a source further than TOLERANCE from its target.
    """
    state = open_sources.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("miss"))
    state = stored(state, "dual")
    h = histogram.alias("h")
    exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")  # noqa: E731  the same in any order, so that reruns agree
    for step in range(1, MAX_STEPS + 1):
        s = state.alias("s")
        x, tokens = F.col("h.size") / F.col("s.mean"), F.col("h.size") * F.col("h.docs")
        rate = _tilt(F.col("s.lam"), x, cap)
        sums = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source")).agg(
            exact(rate * tokens).alias("got"),
            exact(F.when(rate < float(cap), rate * tokens * x).otherwise(0.0)).alias("slope"),
            *(F.first(f"s.{c}").alias(c) for c in ("target", "mean", "lam", "low", "high")),
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        good = (newton > F.coalesce(low, newton - 1)) & (newton < F.coalesce(high, newton + 1)) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs("lam")))
        middle = F.coalesce((low + high) / 2, F.when(over, F.col("lam") * 2 - 1).otherwise(F.col("lam") * 2 + 1))
        miss = F.abs(F.col("got") / F.col("target") - 1)
        lam = F.when(miss <= TOLERANCE, F.col("lam")).when(good, newton).otherwise(middle)
        state = sums.select("source", "target", "mean", lam.alias("lam"), low.alias("low"), high.alias("high"), miss.alias("miss"))
        if step % STEPS_PER_CUT == 0:
            state = stored(state, "dual")
            if state.where(~(F.col("miss") <= TOLERANCE)).isEmpty():
                return state.select("source", "lam")
    raise RuntimeError(f"the dual isn't solved to {TOLERANCE} after {MAX_STEPS} steps")


def _rounded(docs: DataFrame, cap: int) -> DataFrame:
    """docs with copies: in buckets of about BUCKET_DOCS documents of a source, from the largest down, each document
    takes the whole copies nearest to its rate times its size plus what the ones before it still owe."""
    place = F.xxhash64("doc_id", "repeat", "size")
    bucket = F.pmod(place, F.ceil(F.col("docs") / BUCKET_DOCS).cast("long"))
    groups = docs.withColumn("bucket", bucket).groupBy("source", "bucket", "source_size", "target")
    rows = groups.agg(F.sort_array(F.collect_list(F.struct("size", place.alias("place"), "doc_id", "repeat", "rate")), asc=False).alias("rows"))

    def take(acc, r):
        want = r.size * r.rate + acc.owed
        n = F.when(r.size == 0, F.least(F.round(r.rate), F.lit(float(cap)))).otherwise(F.greatest(F.lit(0.0), F.least(F.round(want / r.size), F.lit(float(cap))))).cast("int")
        return F.struct((want - n * r.size).alias("owed"), F.concat(acc.taken, F.array(n)).alias("taken"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate("rows", start, take, lambda acc: acc.taken)
    out = rows.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", taken.alias("taken"))).alias("r"))
    return out.select(F.col("r.rows.doc_id").alias("doc_id"), "source", F.col("r.rows.size").alias("size"), "source_size", "target", F.col("r.rows.rate").alias("rate"), F.col("r.taken").alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of docs.

    size is the number of words (null texts: 0), taken is copies * size and at most cap * size. Repeated rows and null
    ids or sources are ordinary rows; rows alike in id, source and size are interchangeable. Reruns agree: only hashes
    of a row's own values break ties. An empty table gives no rows; documents of no words take nothing.
    """
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    size = F.when(body == "", 0).otherwise(F.size(F.split(body, BLANKS))).cast("long")
    piles = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    piles = stored(piles, "sizes")
    histogram = stored(piles.groupBy("source", "size").agg(F.sum("n").alias("docs")), "histogram")
    targets = stored(source_targets(histogram, weights, share, cap), "targets")
    full = (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12))
    dual = solve(histogram, targets.where(~full & (F.col("target") > 0)), cap).withColumnRenamed("source", "solved")
    t = targets.join(dual, F.col("source").eqNullSafe(F.col("solved")), "left").withColumn("full", full).withColumnRenamed("source", "of")
    x = F.col("size") / (F.col("source_size") / F.col("docs"))
    rate = F.when(F.col("full"), float(cap)).when(F.col("lam").isNull(), 0.0).otherwise(_tilt(F.col("lam"), x, cap))
    rows = piles.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).join(t, F.col("source").eqNullSafe(F.col("of")))
    return _rounded(rows.withColumn("rate", rate), cap).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken (replaced if docs has them).

    Rows alike in id, text and source become one, with their copies added up; any one's other columns stay.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    key = unused(docs, "_key")
    keyed = docs.drop(*made).withColumn(key, F.struct(F.col("doc_id").alias("id"), F.nullif(F.xxhash64("text"), F.lit(0)).alias("hash"), "source"))  # nullable as it is read back: one shuffle serves the join and the grouping
    m = mix(keyed, doc_id=key).groupBy(F.col("doc_id").alias(key), "size", "source_size", "target").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    return keyed.join(m.where("copies > 0"), key).dropDuplicates([key]).drop(key)


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
