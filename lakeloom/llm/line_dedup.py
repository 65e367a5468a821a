"""Line deduplication by pairwise alignment.

Documents are paired by what they share: single lines, two neighbouring lines, and the shortest runs of lines that have
min_words words, from each line on and up to each line. Of each of these the earliest holder (smallest doc_id) stands for
all its holders, so pairs are linear in shared lines, whether a line is rare or in a third of all documents. Every run of
min_words words or more that an earlier document has is made of such shortest runs, so none is missed, whichever document
has it and wherever. A pair is aligned by patience diff over the lines it was found to share: lines that either document
has once are anchors if they keep their order, anchors grow along equal neighbours, and the gaps are aligned likewise.
Blocks of aligned lines are deleted from the later document, and so are blocks that both have line after line, but moved.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, stored, table, unused

MIN_WORDS = 30


def in_order(matches: list[tuple[int, int]]) -> list[int]:
    """Places, by the first number, of a longest subsequence in which the second number rises (patience sorting)."""
    tops, ends, back = [], [], [-1] * len(matches)
    for i, (_, p) in enumerate(matches):
        k = bisect_left(tops, p)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(p)
            ends.append(i)
        else:
            tops[k], ends[k] = p, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(matches: set[tuple[int, int]], repeated: set[int]) -> set[tuple[int, int]]:
    """The matches (order, partner's order) that patience diff aligns: a set that rises in both numbers.

    Anchors are matches of lines that are matched once on either side, at first but for the orders repeated, later
    within the gap; the longest chain of them that keeps its order stays and grows along matches of neighbours.
    """
    out: set[tuple[int, int]] = set()
    gaps = [sorted(matches)]
    while gaps:
        inside = gaps.pop()
        mine, theirs, have = Counter(o for o, _ in inside), Counter(p for _, p in inside), set(inside)
        once = [(o, p) for o, p in inside if mine[o] == theirs[p] == 1 and o not in repeated]
        chain, grown = [once[i] for i in in_order(once)], []
        for k, (o, p) in enumerate(chain):
            before, after = grown[-1] if grown else (-1, -1), chain[k + 1] if k + 1 < len(chain) else None
            while (o - 1, p - 1) in have and o - 1 > before[0] and p - 1 > before[1]:
                o, p = o - 1, p - 1
            while (o, p) in have and (after is None or (o < after[0] and p < after[1])):
                grown.append((o, p))
                o, p = o + 1, p + 1
        out.update(grown)
        orders, between = [o for o, _ in grown], defaultdict(list)
        for o, p in inside:
            k = bisect_left(orders, o)
            if (k == len(grown) or (o < grown[k][0] and p < grown[k][1])) and (k == 0 or p > grown[k - 1][1]):
                between[k].append((o, p))
        gaps += between.values() if grown else []
        repeated = set()
    return out


def diagonals(matches: set[tuple[int, int]]) -> list[list[int]]:
    """The orders of each longest run of matches that are neighbours on both sides."""
    out: list[list[int]] = []
    last = None
    for o, p in sorted(matches, key=lambda m: (m[1] - m[0], m[0])):
        if last == (o - 1, p - 1):
            out[-1].append(o)
        else:
            out.append([o])
        last = o, p
    return out


def aligned(rows: list[tuple], min_words: int, repeated: dict | None = None) -> list[int]:
    """The places to delete of one document, from its shared lines (order, place, words, partner, partner's order).

    A line may have many partners, and many places in one. Of each pair go the blocks of min_words words or more: lines
    that follow each other in this document and are aligned with the partner's, or that follow each other in both. What
    isn't aligned is aligned again without what is, so that moved blocks go too, until no more blocks are found.
    repeated: by partner the orders of lines known to be in either document more than once.
    """
    pairs, lines, gone = defaultdict(set), {}, set()
    for order, place, words, partner, at in rows:
        pairs[partner].add((order, at))
        lines[order] = place, words
    for partner, matches in pairs.items():
        blocks, left, again = diagonals(matches), matches, True
        while again:
            orders = {o for o, _ in patience(left, (repeated or {}).get(partner, set()))}
            found = [b for b in neighbours(sorted(orders)) if sum(lines[o][1] for o in b) >= min_words]
            blocks, left, again = blocks + found, {m for m in left if m[0] not in orders}, bool(found)
        for block in blocks:
            if sum(lines[o][1] for o in block) >= min_words:
                gone.update(block)
    return [lines[o][0] for o in sorted(gone)]


def neighbours(orders: list[int]) -> list[list[int]]:
    """Rising numbers, split where one is missing."""
    out = []
    for o in orders:
        if out and o == out[-1][-1] + 1:
            out[-1].append(o)
        else:
            out.append([o])
    return out


def runs_to_meet(orders: list[int], words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first, after), places in orders: neighbouring lines, two or the fewest of min_words words from or up to a line.

    A block of min_words words that two documents have is the union of such runs within it, which depend on the block
    alone: up to a line, if the block has min_words words until there, else from the block's first line.
    """
    out, at = set(), 0
    for run in neighbours(orders):
        stop = at + len(run)
        out.update((i, i + 2) for i in range(at, stop - 1))
        total, j = 0, at
        for i in range(at, stop):
            while j < stop and total < min_words:
                total, j = total + words[j], j + 1
            if total >= min_words:
                out.add((i, j))
            total -= words[i]
        total, i = 0, at
        for j in range(at, stop):
            total += words[j]
            while total - words[i] >= min_words:
                total, i = total - words[i], i + 1
            if total >= min_words:
                out.add((i, j + 1))
        at = stop
    return {(i, j) for i, j in out if j > i + 1}  # lines of min_words words meet as single lines


def shared_lines(docs: DataFrame) -> DataFrame:
    """(doc, rows): of each document the lines that others have too, as structs (order, place, words, h, id, hash, partner_order, once).

    docs: (doc, text), doc a struct (id, hash). Lines are alike (h) if they are without blanks around and A-Z lowered.
    place counts all lines of a text, order those that aren't blank; rows are by order. id and hash are the line's
    earliest holder, null in that document itself, partner_order is the first place there, and once tells whether it is
    the only one. The lines are hashed once and cut; rows alike in doc collapse where they are collected.
    """
    tidy = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("place"), F.btrim(ascii_lower(x), F.lit(" \t\x0b\f\r")).alias("line")))
    lines = docs.select("doc", F.posexplode(F.filter(tidy, lambda x: x.line != "")).alias("order", "x"))
    lines = stored(lines.select("doc", "order", F.col("x.place").alias("place"), F.xxhash64("x.line").alias("h"), F.size(F.split("x.line", BLANKS)).alias("words")), "lines")
    first = lines.groupBy("h").agg(F.min(F.struct("doc", "order")).alias("first"), F.min(F.struct("doc", (-F.col("order")).alias("back"))).alias("same"), F.max("doc").alias("last"))
    first = first.where(F.col("first.doc") < F.col("last"))
    first = first.select("h", F.col("first.doc").alias("partner"), F.col("first.order").alias("partner_order"), (F.col("first.order") == -F.col("same.back")).alias("once"))
    of = F.when(F.col("partner") < F.col("doc"), F.col("partner"))
    kinds = F.struct("order", "place", "words", "h", of["id"].alias("id"), of["hash"].alias("hash"), "partner_order", "once")
    return lines.join(first, "h").groupBy("doc").agg(F.array_sort(F.collect_set(kinds), lambda a, b: a.order - b.order).alias("rows"))


def shared_runs(held: DataFrame, min_words: int) -> DataFrame:
    """(doc, runs): of shared_lines(), the runs_to_meet() that an earlier document has, as structs (order, n, id, hash, partner_order)."""

    @F.pandas_udf("array<struct<order:int,n:int,key:bigint>>")
    def keys(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            orders, h = [r["order"] for r in g], np.array([r["h"] for r in g], "<i8")
            spans = runs_to_meet(orders, [r["words"] for r in g], min_words)
            digest = lambda i, j: int.from_bytes(hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest(), "little", signed=True)
            out.append([{"order": orders[i], "n": j - i, "key": digest(i, j)} for i, j in spans])
        return pd.Series(out, dtype=object)

    runs = held.select("doc", F.explode(keys("rows")).alias("x")).select("doc", "x.*")
    first = runs.groupBy("key").agg(F.min(F.struct("doc", "order")).alias("first"), F.max("doc").alias("last"))
    first = first.where(F.col("first.doc") < F.col("last")).select("key", F.col("first.doc").alias("partner"), F.col("first.order").alias("partner_order"))
    met = runs.join(first, "key").where(F.col("partner") < F.col("doc"))
    return met.groupBy("doc").agg(F.collect_list(F.struct("order", "n", F.col("partner.id").alias("id"), F.col("partner.hash").alias("hash"), "partner_order")).alias("runs"))


def cut_shared_blocks(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut, and lines_cut and words_cut (columns of these names are replaced).

    Of every block of lines of min_words words that an earlier document has line after line, and of every such block that is
    aligned with an earlier document it met (see aligned()), the later document's copy goes; a document may be left with an empty text, but each row stays. Rows alike in id and text are one document
    (all of them are cut), other rows of one id are ordered by a hash of their text; rows of a null id or text stay as
    they are. No line is left out for being frequent.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    named = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(key.alias("doc"), F.col(text).alias("text"))

    @F.pandas_udf("array<boolean>")
    def flags(groups: pd.Series, met: pd.Series) -> pd.Series:
        """By place, whether the line goes; as far as the last that does."""
        out = []
        for g, runs in zip(groups, met, strict=True):
            lines, times, repeated = {r["order"]: (r["order"], r["place"], r["words"]) for r in g}, Counter(r["h"] for r in g), defaultdict(set)
            for r in g:
                if r["hash"] is not None and (times[r["h"]] > 1 or not r["once"]):
                    repeated[r["id"], r["hash"]].add(r["order"])
            rows = {(*lines[r["order"]], (r["id"], r["hash"]), r["partner_order"]) for r in g if r["hash"] is not None}
            for r in runs if runs is not None else ():
                rows.update((*lines[r["order"] + k], (r["id"], r["hash"]), r["partner_order"] + k) for k in range(r["n"]))
            places = aligned(list(rows), min_words, repeated)
            out.append(np.isin(np.arange(max(places, default=-1) + 1), places).tolist())
        return pd.Series(out)

    held = stored(shared_lines(named), "shared-lines")
    enough = F.aggregate("rows", F.lit(0), lambda n, r: n + F.when(r.hash.isNotNull(), r.words).otherwise(0)) >= min_words
    found = held.where(enough).join(shared_runs(held, min_words), "doc", "left").withColumn("gone", flags("rows", "runs")).where(F.size("gone") > 0)
    cut = lambda i: F.coalesce(F.get("gone", i), F.lit(False))
    total = F.aggregate(F.filter("rows", lambda r: cut(r.place)), F.lit(0), lambda n, r: n + r.words)
    own, of, gone, n_lines, n_words = (unused(docs, c) for c in ("_doc", "_of", "_gone", "_lines", "_words"))
    found = found.select(F.col("doc").alias(of), F.col("gone").alias(gone), F.size(F.filter("gone", lambda x: x)).alias(n_lines), total.alias(n_words))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False))), "\n")
    rest = [c for c in docs.columns if c not in ("lines_cut", "words_cut")]
    joined = docs.select(*rest, key.alias(own)).join(found, F.col(own) == F.col(of), "left")
    new_text = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    return joined.select(*(new_text.alias(c) if c == text else F.col(c) for c in rest), F.coalesce(n_lines, F.lit(0)).alias("lines_cut"), F.coalesce(n_words, F.lit(0)).alias("words_cut"))


def op4_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_shared_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_cut", "words_cut", "text")
