"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the smallest 5-gram hash of each 9 consecutive 5-grams, so any 13 words in a row that two
texts share give both the same fingerprint. Documents and benchmark items meet on fingerprints; the hits of a document
are extended to every 13-word window that has the fingerprint, and these are held against the items' windows as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, split_words, stored, table, unused

#: Everything in ASCII but digits and lower-case letters separates words (upper case is lowered before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 5
MINIMA = WINDOW - GRAM + 1


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _minima(w: Column) -> Column:
    """The fingerprint of each WINDOW-word window of w, by start; of shorter w none."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
    smallest = let(grams, lambda h: F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.array_min(F.slice(h, i, MINIMA))))
    return F.when(F.size(w) >= WINDOW, smallest).otherwise(F.array().cast("array<bigint>"))


def _runs(m: Column) -> Column:
    """Runs of equal fingerprints: structs (print, first, last) of window starts, from 0."""
    n = F.size(m)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    runs = let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(m, i).alias("print"), i.alias("first"), (F.coalesce(F.get(b, k + 1), n) - 1).alias("last"))))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<struct<print:bigint,first:int,last:int>>"))


def _text(w: Column, start: Column, length) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, window, print): the distinct windows of each item, n words each; print is null where n < WINDOW."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = items.where(F.size("w") >= WINDOW).select("item_id", "w", F.posexplode(_minima(F.col("w"))).alias("at", "print"))
    long = long.select("item_id", F.lit(WINDOW).alias("n"), _text(F.col("w"), F.col("at"), WINDOW).alias("window"), "print")
    short = items.where(F.size("w") < WINDOW).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("window"), F.lit(None).cast("long").alias("print"))
    return long.union(short).distinct()


def _gram(w: Column, n: int):
    return lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(n))).alias("print"), i.alias("first"), i.alias("last"), F.lit(n).alias("n"))


def _prints(w: Column, key: Column, lengths: list[int]) -> Column:
    """A document's rows (print, first, last, n): its fingerprint runs, its n-grams for the lengths of short items, and
    one of n = 0 that holds the number of words."""
    typed = lambda r: F.struct(r["print"].alias("print"), r["first"].alias("first"), r["last"].alias("last"), F.lit(WINDOW).alias("n"))
    parts = [F.array(F.struct(F.xxhash64(key).alias("print"), F.size(w).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("n"))), F.transform(let(_minima(w), _runs), typed)]
    for n in lengths:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), _gram(w, n))
        parts.append(F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<struct<print:bigint,first:int,last:int,n:int>>")))
    return F.concat(*parts)


def _starts(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, n_words, starts): for each document the runs of window starts that may occur in an item.

    Every document's words are split once; of the rows that leave it, those stay whose print the benchmark has.
    """
    rows = docs.select("key", F.explode(let(words(F.col("text")), lambda w: _prints(w, F.col("key"), lengths))).alias("r")).select("key", "r.*")
    known = windows.where("print IS NOT NULL").select("print", F.lit(WINDOW).alias("n"))
    for n in lengths:
        gram = F.split("window", " ")
        known = known.union(windows.where(F.col("n") == n).select(F.xxhash64(*(F.get(gram, F.lit(k)) for k in range(n))).alias("print"), "n"))
    known = known.distinct().withColumn("hit", F.lit(True))
    kept = rows.join(known, ["print", "n"], "left").where("hit OR n = 0")
    return kept.groupBy("key").agg(F.max(F.when(F.col("n") == 0, F.col("first"))).alias("n_words"), F.collect_set(F.when(F.col("hit"), F.struct("first", "last", "n"))).alias("starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", hit_share: int = 20) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for each (id, hash of text) key of docs; see per_row().

    A window is WINDOW consecutive words of an item, or all of a shorter item that has words. n_hit counts a document's
    words inside an occurrence of any window, n_items the items with an occurring window; items_sha256 is over their
    ids, sorted as strings and comma-joined. Contaminated: n_hit > 0 and hit_share * n_hit >= n_words. Null and
    wordless texts, an empty benchmark and repeated rows are ordinary cases (rows alike in id and text share a result).
    """
    docs = docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    windows = item_windows(benchmark)
    lengths = sorted(r[0] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect())  # 12 at most
    found = stored(_starts(docs, windows, lengths), "starts")  # read twice: cut, so that the texts are fingerprinted once
    hits = found.where(F.size("starts") > 0).select(F.col("key").alias("hit_key"), "starts")
    texts = docs.join(hits, F.col("hit_key") == F.col("key")).dropDuplicates(["key"])
    at = texts.select("key", words(F.col("text")).alias("w"), "starts")
    at = at.select("key", F.explode(let(F.col("w"), lambda w: F.flatten(F.transform("starts", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(i.alias("start"), r["n"].alias("n"), _text(w, i, r["n"]).alias("window"))))))).alias("x"))
    at = at.select("key", "x.*").distinct()
    occur = at.join(windows.select("n", "window").distinct(), ["n", "window"])
    spans = occur.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = F.aggregate("spans", zero, lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.end))).alias("n"), F.greatest(a.end, s.end).alias("end")), lambda a: a.n)
    items = occur.select("key", "n", "window").distinct().join(windows.select("n", "window", "item_id"), ["n", "window"]).select("key", "item_id").distinct()
    items = items.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    result = found.select("key", "n_words").join(spans.select("key", cover.alias("n_hit")), "key", "left").join(items, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    result = result.select("key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return result.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * hit_share >= F.col("n_words")))


def _key(doc_id: str, text: str) -> Column:
    """What tells documents apart: the id and a hash of the text."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def per_row(docs: DataFrame, result: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """result of contamination() with a row for each row of docs, repeated rows too."""
    return docs.select(_key(doc_id, text).alias("key")).join(result, "key").withColumn("doc_id", F.col("key.doc_id")).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with docs' columns."""
    key = unused(docs, "_key")
    bad = contamination(docs, benchmark, doc_id, text).where("contaminated").select(F.col("key").alias(key))
    return docs.withColumn(key, _key(doc_id, text)).join(bad, key, "left_anti").select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = contamination(docs, table(spark, sf_dir, "benchmark"))
    return per_row(docs, result).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
