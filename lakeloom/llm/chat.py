"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

Chat logs often hold a conversation again after every turn. Each turn gets the hash of its conversation up to it; a
conversation whose whole hash is another's prefix hash is a snapshot of that one and goes, and the rest are rendered.
Only hashes are ranked, joined and compared; texts are read again for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table


def _content() -> tuple:
    """Two hashes over a turn's role and text; null and empty ones differ."""
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def _in_order(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """rows cut, with part and rank: where they lie in a range partitioning by group and order, and the row's number among
    its group's in that part.

    A group of any size is spread over parts, and the rows of an earlier part come before those of a later one.
    """
    spread = rows.repartitionByRange(*(F.col(g) for g in group), *order).withColumn("part", F.spark_partition_id())
    spread = stored(spread, "ranges")
    return spread.withColumn("rank", F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)))


def _before(sums: DataFrame, group: list[str], **totals) -> DataFrame:
    """sums, a row for each group and part, with the totals (name: aggregate) over the group's earlier parts, and the
    columns that joins need renamed. A group's parts are as many as the shuffle's partitions at most."""
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(g).alias(f"of_{g}") for g in group]
    return sums.select(*names, F.col("part").alias("of_part"), *(F.coalesce(a.over(earlier), F.lit(0)).alias(n) for n, a in totals.items()))


def _same(group: list[str]):
    on = F.col("part") == F.col("of_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return on


def _placed(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """rows with pos, the number of each in its group's order, from 1, and part."""
    ranked = _in_order(rows, group, order)
    counts = _before(ranked.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n")), group, offset=F.sum("n"))
    placed = ranked.join(counts, _same(group)).withColumn("pos", F.col("rank") + F.col("offset"))
    return placed.drop("rank", "offset", "of_part", *(f"of_{g}" for g in group))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turns, h1, h2): for each turn the hashes h1, h2 of the turns 1 to pos; turns is their whole number.

    The turns are ordered by turn (null last), role and text; repeated rows count once. A prefix's hash is the
    exclusive or of its turns' hashes, each over place, role and text, so that the parts of a long conversation, whether
    its turns are numbered or not, are hashed apart and then offset by what stands before them.
    """
    c1, c2 = _content()
    base = conversations.select("conv_id", "turn", "role", "text")
    slim = stored(base.select("conv_id", "turn", "role", c1.alias("c1"), c2.alias("c2")).distinct(), "turns")
    # The few turns of one number and role are told apart by their texts, which only these need.
    tie = ["conv_id", "turn", "role"]
    ties = slim.groupBy(*tie).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct(*tie).alias("tied"))
    texts = base.join(stored(ties, "ties"), F.struct(*tie) == F.col("tied"), "left_semi").select(*tie, "text", c1.alias("c1"), c2.alias("c2")).distinct()
    texts = _placed(texts, tie, [F.col("text").asc_nulls_first()]).select(F.struct(*tie, "c1", "c2").alias("row"), F.col("pos").alias("tie"))
    slim = slim.join(stored(texts, "tied"), F.struct(*tie, "c1", "c2") == F.col("row"), "left").withColumn("tie", F.coalesce("tie", F.lit(0))).drop("row")

    t = _placed(slim, ["conv_id"], [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("tie").asc()])
    t = t.select("conv_id", "part", "pos", F.xxhash64("pos", "c1", "c2").alias("t1"), F.xxhash64("c2", "pos", "c1").alias("t2"))
    t = stored(t, "placed")
    sums = t.groupBy("conv_id", "part").agg(F.max("pos").alias("last"), F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = _before(sums, ["conv_id"], b1=F.bit_xor("b1"), b2=F.bit_xor("b2"))
    turns = t.groupBy(F.col("conv_id").alias("whole")).agg(F.max("pos").alias("turns"))
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(before, _same(["conv_id"])).join(turns, F.col("conv_id").eqNullSafe(F.col("whole")))
    return t.select("conv_id", "pos", "turns", *(F.bit_xor(f"t{i}").over(running).bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies, conversation) of maximal conversations: those that no longer one starts with.

    Of equal conversations the smallest conv_id stays, and copies is their number. Rows of a null conv_id are one
    conversation; null roles and texts differ from empty ones. conversation is a struct of conv_id, equal for nulls too.
    """
    t = stored(prefix_hashes(conversations), "prefixes")
    whole = t.where("pos = turns").groupBy("turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    parts = t.where("pos < turns").select(F.col("pos").alias("turns"), "h1", "h2").distinct()
    kept = whole.join(parts, ["turns", "h1", "h2"], "left_anti").select(F.struct("conv_id").alias("kept"), "copies")
    rows = conversations.select("conv_id", "turn", "role", "text", F.struct("conv_id").alias("conversation"))
    return rows.join(stored(kept, "kept"), F.col("conversation") == F.col("kept")).drop("kept")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, rendered): a row for each conversation of collapse_snapshots(), its turns in order
    between the two marks, repeated rows once.

    A mark inside a role or text gets a blank after its first character; null roles and texts are empty.
    """
    plain = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit(start), F.lit(f"{start[:1]} {start[1:]}")), F.lit(end), F.lit(f"{end[:1]} {end[1:]}"))
    line = lambda x: F.concat(F.lit(start), plain(x.role), F.lit("\n"), plain(x.text), F.lit(f"{end}\n"))
    key = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")  # its order is that of the turns
    rows = turns.groupBy("conversation").agg(F.sort_array(F.collect_set(key)).alias("t"), F.max("copies").alias("copies"))
    return rows.select("conversation.conv_id", F.size("t").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("t", line), "").alias("rendered"))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse_snapshots(table(spark, sf_dir, "conversations")))
