"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another; each model is a logistic regression over word counts that also gets
the earlier categories' probabilities. For training these are out of fold: each row's come from models that never saw it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, unused

#: The labels have one toxicity flag and a quality flag; the chain goes from the narrower kinds to the whole.
CATEGORIES = {"toxic_junk": "toxic = 1 AND quality = 0", "toxic_prose": "toxic = 1 AND quality = 1", "toxic": "toxic = 1"}
#: Bounds of a model: the labelled documents it is fitted on, the folds, and the word features it weighs, the best of 2**18 hashes.
MAX_TRAIN, FOLDS, FEATURES, THRESHOLD = 8000, 3, 2000, 0.5
_BITS, _PREFIX, _WORDS = 18, 5, re.compile(r"\w+")
_KEPT_WORDS = 200_000


def slots(word: str) -> tuple[int, ...]:
    """The hashed features of a word: itself and, of longer words, their first letters."""
    mask = (1 << _BITS) - 1
    own = zlib.crc32(word.encode()) & mask
    return (own, zlib.crc32(b"^" + word[:_PREFIX].encode()) & mask) if len(word) > _PREFIX else (own,)


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def value(count: np.ndarray) -> np.ndarray:
    """A feature's value: the logarithm of 1 and its occurrences."""
    return np.log1p(count)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, slot, val) for each feature that a document has."""
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            words, found = word_counts(text.as_py()), Counter()
            for w, n in words.items():
                for s in slots(w):
                    found[s] += n
            vals = value(np.fromiter(found.values(), np.float64, len(found)))
            ids = batch.column("doc_id").take(pa.array([i] * len(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.int32()), pa.array(vals)], ["doc_id", "slot", "val"])


def best_slots(features: DataFrame, sample: DataFrame, categories: int, folds: int, most: int) -> DataFrame:
    """(category, held, slot): the `most` features that tell a category's classes apart best outside fold held (-1: in all).

    Of features in two documents or more there, those count whose positives stray furthest from the share of all; ties
    by slot. The counts are aggregated by feature; a ranked group has one row a feature, 2**18 at most.
    """
    totals = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(categories))).collect()}  # a row a fold
    counts = features.join(F.broadcast(sample), "doc_id").groupBy("slot").agg(
        *(F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in range(folds)),
        *(F.sum(F.when(F.col("fold") == f, F.col(f"y{i}")).otherwise(0)).alias(f"y{i}_{f}") for f in range(folds) for i in range(categories)),
    )
    ranked = []
    for i in range(categories):
        for held in range(-1, folds):
            used = [f for f in range(folds) if f != held]
            n, positive = sum(totals[f]["n"] for f in used if f in totals), sum(totals[f][f"y{i}"] for f in used if f in totals)
            with_any, with_pos = sum(F.col(f"n_{f}") for f in used), sum(F.col(f"y{i}_{f}") for f in used)
            score = F.when(with_any >= 2, F.abs(with_pos - with_any * (positive / max(n, 1))) / F.sqrt(with_any + 1)).otherwise(0.0)
            ranked.append(F.struct(F.lit(i).alias("category"), F.lit(held).alias("held"), score.alias("score")))
    ranked = counts.select("slot", F.explode(F.array(*ranked)).alias("r")).select("slot", "r.*").where("score > 0")
    place = F.row_number().over(Window.partitionBy("category", "held").orderBy(F.desc("score"), "slot"))
    return ranked.withColumn("place", place).where(F.col("place") <= most).select("category", "held", "slot")


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.15, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam over the whole sample: the weights of width sparse and of the dense columns, and the bias."""
    n, pos = len(y), y.sum()
    w = np.concatenate([np.zeros(width + dense.shape[1]), [np.log((pos + 0.5) / (n - pos + 0.5))]])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if 0 < pos < n else 1):
        z = np.bincount(rows, vals * w[cols], n) + dense @ w[width:-1] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(cols, vals * e[rows], width), dense.T @ e, [e.sum()]])
        g[:-1] += l2 * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _train_fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One model: trained on the rows outside fold `held`, with probabilities for the rows inside."""
    pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
    held = int(pdf["held"].iloc[0])
    out = (pdf["fold"] == held).to_numpy()
    y, dense = pdf["y"].to_numpy(float), np.array(pdf["probs"].tolist(), float).reshape(len(pdf), -1)
    lists = [np.array(x if x is not None else [], np.int64) for x in pdf["slots"]]
    rows, c = np.repeat(np.arange(len(pdf)), [len(x) for x in lists]), np.concatenate(lists)
    v = np.concatenate([np.array(x if x is not None else [], float) for x in pdf["vals"]])
    chosen, c = np.unique(c, return_inverse=True)
    use, into, k = ~out[rows], np.cumsum(~out) - 1, len(chosen)
    w = fit(into[rows[use]], c[use], v[use], k, dense[~out], y[~out])
    z = np.bincount(rows, v * w[c], len(pdf)) + dense @ w[k:-1] + w[-1]
    ids, model = pdf.loc[out, "doc_id"].tolist(), held < 0
    row = {"held": held, "doc_ids": ids, "seen": probability(z[out]).tolist(), "slots": chosen.tolist() if model else [], "weights": w[:k].tolist() if model else []}
    return pd.DataFrame([{**row, "chain": w[k:-1].tolist(), "bias": float(w[-1])}])


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, max_train: int = MAX_TRAIN, folds: int = FOLDS, features: int = FEATURES
) -> list[dict]:
    """The models of the chain, in order; empty if no document is labelled.

    At most max_train labelled documents are used, those of the smallest hash of their id; labels of documents that
    docs hasn't don't count. A document labelled more than once counts by its largest flags, a document of several
    texts by that of the smallest hash; null labels and ids are left out. Each model weighs `features` words at most.
    """
    names = list(categories)
    ys = [f"y{i}" for i in range(len(names))]
    flags = [F.expr(f"CAST(({e}) AS INT)").alias(y) for y, e in zip(ys, categories.values(), strict=True)]
    marked = labels.select("doc_id", *flags).dropna().groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys))
    marked = marked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int").alias("fold")
    sample = stored(marked.select("doc_id", fold, *ys), "toxicity-sample")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id")  # max_train rows bound what is broadcast
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    id_type = sample.schema["doc_id"].dataType.simpleString()
    found = stored(texts.mapInArrow(_features, f"doc_id {id_type}, slot int, val double"), "toxicity-features")
    best = stored(best_slots(found, sample, len(names), folds, features), "toxicity-slots")
    sample = sample.withColumn("probs", F.array().cast("array<double>"))
    schema = f"held int, doc_ids array<{id_type}>, seen array<double>, slots array<long>, weights array<double>, chain array<double>, bias double"
    models = []
    for i, name in enumerate(names):
        every = sample.withColumn("y", F.col(f"y{i}")).withColumn("held", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1))))
        chosen = found.join(F.broadcast(best.where(F.col("category") == i).drop("category")), "slot")  # features * (folds + 1) rows bound it
        chosen = chosen.groupBy("held", "doc_id").agg(F.collect_list(F.struct("slot", "val")).alias("x"))
        every = every.join(chosen, ["held", "doc_id"], "left").select("held", "doc_id", "fold", "y", "probs", F.col("x.slot").alias("slots"), F.col("x.val").alias("vals"))
        trained = stored(every.groupBy("held").applyInPandas(_train_fold, schema), "toxicity-model")
        last = trained.where("held = -1").select("slots", "weights", "chain", "bias").first()
        if last is None:
            return []
        models.append({"name": name, "slots": dict(zip(last["slots"], last["weights"], strict=True)), "chain": list(last["chain"]), "bias": last["bias"]})
        seen = trained.where("held >= 0").select(F.explode(F.arrays_zip("doc_ids", "seen")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.seen").alias("p"))
        sample = sample.join(seen, "doc_id").withColumn("probs", F.concat("probs", F.array("p"))).drop("p")
    return models


class _Words(dict):
    """Word to the features of it that any model uses."""

    def __init__(self, used: set[int]):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = found = tuple(s for s in slots(word) if s in self.used)
        return found


def chain_probabilities(text: str | None, models: list[dict], known: _Words) -> list[float]:
    words, found = word_counts(text), Counter()
    for w, n in words.items():
        for s in known[w]:
            found[s] += n
    vals = dict(zip(found, value(np.fromiter(found.values(), np.float64, len(found))).tolist(), strict=True))
    probs: list[float] = []
    for m in models:
        z = m["bias"] + sum(c * p for c, p in zip(m["chain"], probs, strict=True)) + sum(m["slots"].get(s, 0.0) * v for s, v in sorted(vals.items()))
        probs.append(float(probability(z)))
    return probs


def score(docs: DataFrame, models: list[dict], names: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs with a column p_<category> for each model; whole texts count, null and empty ones by the models' biases.

    Without models (an empty table of labels) the columns of names are null.
    """
    names = [m["name"] for m in models] or list(names or CATEGORIES)
    if not models:
        return docs.withColumns({f"p_{n}": F.lit(None).cast("double") for n in names})
    used = {s for m in models for s in m["slots"]}

    @F.pandas_udf("array<double>")
    def chain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words(used)
        for texts in parts:
            yield pd.Series([chain_probabilities(t, models, known) for t in texts], dtype=object)

    p = unused(docs, "_p")
    out = docs.withColumn(p, chain(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({f"p_{n}": F.col(p)[i] for i, n in enumerate(names)}).drop(p)


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = train_chain(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, models)
    return scored.select("doc_id", *(f"p_{n}" for n in CATEGORIES), F.coalesce(F.col("p_toxic") >= THRESHOLD, F.lit(False)).alias("toxic"))
