"""Language-model scores from a subword lattice.

A text's probability is the sum over all ways to cut its words into pieces of an existing vocabulary, times the end's.
Pieces begin no word but with the word mark, so words are independent: each distinct word is scored once, by a forward
recursion in log space, and documents add up their words. Long words are first cut where no piece of the vocabulary
spans. The vocabulary's own scores (ranks) give the first piece probabilities; rounds of expected counts over the kinds
of training words replace them. A word met in training is one more piece, with its discounted share of the training
tokens; all that is discounted goes to the cuts into pieces.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table

MARK, ROUNDS, HELD_OUT = "▁", 3, 2
#: The most frequent words, looked up where the documents are; the others are joined. Words scored at once.
NEAR_WORDS, AT_ONCE = 100_000, 40_000
#: Characters up to which words of one length are scored together; parts that are longer are walked one by one.
LONG = 48
_MULTIPLIER, _HELD_WORDS = np.uint64(0x9E3779B97F4A7C15), 300_000
#: Hashes of pieces are looked up by their upper bits first.
_BUCKET_BITS = 20
_SHIFT = np.uint64(64 - _BUCKET_BITS)


class Lattice:
    """All cuts of words into vocabulary pieces, many words of one length at a time. A character that is no piece costs
    the slot `other` and 1/256 for each of its bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        self.other = len(pieces)
        ranks = np.array([-model.get_score(i) for i in ids])
        self.prior = np.concatenate([1 / (1 + ranks - ranks.min()), [1e-4]])
        table: dict[int, int] = {}
        for k, p in enumerate(pieces):
            codes, h = np.array([ord(x) for x in p], np.uint64), np.zeros(1, np.uint64)
            for n, c in enumerate(codes, 1):
                h = (h + c) * _MULTIPLIER
                table[int(h[0])] = k if n == len(codes) else table.get(int(h[0]), -1)
        self.keys = np.array(sorted(table), np.uint64)
        self.piece = np.array([table[int(k)] for k in self.keys], np.int64)
        starts = np.searchsorted(self.keys, np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << _SHIFT)
        self.starts = starts.astype(np.int32)
        self.slot = {p: k for k, p in enumerate(pieces)}
        self.begins = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.pairs = np.array(sorted({ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)}))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, k): whether each h is a key, and if so which; the keys of one bucket share their upper bits."""
        last = len(self.keys) - 1
        k = np.minimum(self.starts[h >> _SHIFT], last)
        hit = self.keys[k] == h
        rest = np.nonzero(self.keys[k] < h)[0]
        while len(rest):  # keys rise, and most buckets have one or none
            rest = rest[k[rest] < last]
            k[rest] += 1
            key = self.keys[k[rest]]
            hit[rest[key == h[rest]]] = True
            rest = rest[key < h[rest]]
        return hit, k

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | float]]:
        """(from, to, words, slots, cost) by from; codes has a row of characters for each word."""
        count, n = codes.shape
        wide = codes.astype(np.uint64)
        for i in range(n):
            rows, h = np.arange(count), np.zeros(count, np.uint64)
            for j in range(i + 1, n + 1):
                h = (h + wide[rows, j - 1]) * _MULTIPLIER
                hit, k = self.places(h)
                slots = np.where(hit, self.piece[k], -1)
                whole = slots >= 0
                if j == i + 1 and not whole.all():
                    lone = rows[~whole]
                    c = codes[lone, i]
                    yield i, j, lone, np.full(len(lone), self.other), -math.log(256) * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
                if whole.any():
                    yield i, j, rows[whole], slots[whole], 0.0
                rows, h = rows[hit], h[hit]
                if not len(rows):
                    break

    def parts(self, text: str) -> list[str]:
        """A word's parts: itself, or if it is long what lies between the places that no piece spans."""
        if len(text) <= LONG:
            return [text]
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = c[:-1] << 21 | c[1:]
        spanned = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        ends = [*(np.nonzero(~spanned)[0] + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def apart(self, words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct parts of words, and for each part of each word (its word's place, its own place)."""
        seen: dict[str, int] = {}
        of, at = [], []
        for k, w in enumerate(words):
            for p in self.parts(MARK + w.decode("utf-8", "replace")):
                of.append(k)
                at.append(seen.setdefault(p, len(seen)))
        return list(seen), np.array(of, np.int64), np.array(at, np.int64)

    def by_length(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, rows of characters) of the texts up to LONG, those of one length at a time."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for n in np.unique(lengths[lengths <= LONG]):
            at = np.nonzero(lengths == n)[0]
            yield at, np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)

    def steps(self, text: str, i: int, logp: list[float]) -> Iterator[tuple[int, int, float]]:
        """(to, slot, log weight) of the pieces that begin at place i of text."""
        if text[i] not in self.slot:
            yield i + 1, self.other, logp[self.other] - math.log(256) * len(text[i].encode("utf-8", "surrogatepass"))
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece not in self.begins:
                return
            if (k := self.slot.get(piece)) is not None:
                yield j, k, logp[k]

    def walk(self, text: str, logp: list[float]) -> array:
        """The forward recursion over one text: by place, the log probability of all cuts up to there."""
        a = array("d", [-math.inf]) * (len(text) + 1)
        a[0] = 0.0
        for i in range(len(text)):
            for j, _, step in self.steps(text, i, logp):
                x, y = a[j], a[i] + step
                a[j] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return a

    def log_probabilities(self, words: list[bytes], logp: np.ndarray, own: np.ndarray | float = -np.inf, cuts: float = 0.0) -> np.ndarray:
        """The natural logarithm of each word's probability, over all its cuts: own, the weight of the edge that spans the
        whole word, and cuts, that of all ways over the vocabulary's pieces together."""
        texts, of, at = self.apart(words)
        lp, plain = np.empty(len(texts)), logp.tolist()
        for rows_at, codes in self.by_length(texts):
            a = np.full((codes.shape[1] + 1, len(rows_at)), -np.inf)
            a[0] = 0
            for i, j, rows, slots, cost in self.edges(codes):
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logp[slots] + cost)
            lp[rows_at] = a[-1]
        for k, text in enumerate(texts):
            if len(text) > LONG:
                lp[k] = self.walk(text, plain)[-1]
        return np.logaddexp(own, cuts + np.bincount(of, lp[at], len(words)))

    def expected(self, words: list[bytes], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each slot is used in counts[k] copies of words[k], weighing cuts by their probability."""
        texts, of, part = self.apart(words)
        counts, out, plain = np.bincount(part, counts[of], len(texts)), np.zeros(len(logp)), logp.tolist()
        for at, codes in self.by_length(texts):
            n, edges = codes.shape[1], list(self.edges(codes))
            a, b = np.full((n + 1, len(at)), -np.inf), np.full((n + 1, len(at)), -np.inf)
            a[0], b[n] = 0, 0
            for i, j, rows, slots, cost in edges:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logp[slots] + cost)
            for i, j, rows, slots, cost in reversed(edges):
                step = logp[slots] + cost + b[j, rows]
                b[i, rows] = np.logaddexp(b[i, rows], step)
                out += np.bincount(slots, np.exp(a[i, rows] + step - a[n, rows]) * counts[at[rows]], len(out))
        for k, text in enumerate(texts):
            if len(text) > LONG:
                a, b = self.walk(text, plain), array("d", [0.0]) * (len(text) + 1)
                for i in range(len(text) - 1, -1, -1):
                    ways = [(slot, step + b[j]) for j, slot, step in self.steps(text, i, plain)]
                    top = max(w for _, w in ways)
                    b[i] = top + math.log(sum(math.exp(w - top) for _, w in ways))
                    for slot, w in ways:
                        out[slot] += counts[k] * math.exp(a[i] + w - a[-1])
        return out


@lru_cache(maxsize=2)
def lattice(model_file: str) -> Lattice:
    return Lattice(model_file)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and the ASCII blanks only


def _in_lots(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list]:
    """Columns of batches, about AT_ONCE rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield [pa.chunked_array([x.column(n) for x in held]) for n in names]
            held = []
    if held:
        yield [pa.chunked_array([x.column(n) for x in held]) for n in names]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of docs (held_out, text), with its count in the texts that aren't held out."""

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for held, text in zip(b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held:
                    for w in split(text):
                        found.setdefault(w, 0)
                else:
                    found.update(split(text))
                if len(found) > _HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
                    found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return docs.select("held_out", "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def train(words: DataFrame, model_file: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the slots after rounds of expected counts over the words (word, c) with c > 0, each kind once.

    New words resemble the kinds of words met, not the tokens. The driver gets one number a vocabulary piece and round.
    """
    lat = lattice(model_file)
    p = lat.prior / lat.prior.sum()
    for _ in range(rounds):
        logp = np.log(p)

        def expect(batches, logp=logp):
            lat, total = lattice(model_file), np.zeros(len(logp))
            for (w,) in _in_lots(batches, ("word",)):
                total += lat.expected(w.to_pylist(), np.ones(len(w)), logp)
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

        sums = words.where("c > 0").mapInArrow(expect, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(p), 0.01)
        n[sums["slot"].to_numpy()] += sums["n"].to_numpy()
        p = n / n.sum()
    return np.log(p)


def score_texts(docs: DataFrame, model_file: str, rounds: int = ROUNDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, held_out, text).

    Tokens are the words and one end. base_score adds log10((c + 1) / (N + V + 1)) over them, c being a token's count
    in the N tokens of V kinds of the texts that aren't held out; score is the log10 of the text's probability under
    the lattice model. Null texts are empty, repeated rows count and are scored each; without training texts c, N and
    V are 0 and the vocabulary's own scores stand.
    """
    words = stored(word_counts(docs), "words")
    texts = docs.where("NOT held_out").count()
    n, kinds, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), *(F.count_if(x) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    n, v = n + texts, kinds + (texts > 0)
    logp = train(words, model_file, rounds if kinds else 0)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    new = discount * kinds / n if kinds else 1 / (n + 1)  # the share of tokens that are cut into pieces
    below, end_base = math.log10(n + v + 1), math.log10((texts + 1) / (n + v + 1))
    end_score = math.log10(max(texts, 1) / max(n, 1))

    def score(batches):
        lat = lattice(model_file)
        for w, c in _in_lots(batches, ("word", "c")):
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c.to_numpy() - discount, 0) / max(n, 1))
            lp = lat.log_probabilities(w.to_pylist(), logp, own, math.log(new)) / math.log(10)
            yield pa.RecordBatch.from_arrays([w.combine_chunks(), c.combine_chunks(), pa.array(lp)], ["word", "c", "lp"])

    scored = stored(words.mapInArrow(score, "word binary, c long, lp double"), "scored-words")
    near = {bytes(r["word"]): (r["c"] > 0, math.log10(r["c"] + 1) - below, r["lp"]) for r in scored.orderBy(F.desc("c"), "word").limit(near_words).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(near)  # near_words entries bound it
    id_field = docs.schema["doc_id"]
    schema = f"uid long, doc_id {id_field.dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long"
    arrow = pa.schema([("uid", pa.int64()), ("doc_id", to_arrow_type(id_field.dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("tf", pa.int64())])

    def parts(batches):
        """A row for each document with what its frequent words add, and one for each of its other words."""
        near = shared.value
        for b in batches:
            uids, ids, helds = (b.column(c).to_pylist() for c in ("uid", "doc_id", "held_out"))
            docs_out, far_uid, far_word, far_n = [], [], [], []
            for uid, i, held, text in zip(uids, ids, helds, b.column("text"), strict=True):
                found = Counter(split(text.as_py()))
                known, base, total = int(texts > 0), end_base, end_score
                for w, k in found.items():
                    if (x := near.get(w)) is not None:
                        known += k * x[0]
                        base += k * x[1]
                        total += k * x[2]
                    else:
                        far_uid.append(uid)
                        far_word.append(w)
                        far_n.append(k)
                docs_out.append((uid, i, held, found.total() + 1, known, base, total, b" %d" % uid, 0))
                if len(far_n) > 200_000:
                    yield from flush(docs_out, far_uid, far_word, far_n)
                    docs_out, far_uid, far_word, far_n = [], [], [], []
            yield from flush(docs_out, far_uid, far_word, far_n)

    def flush(docs_out, far_uid, far_word, far_n):
        if docs_out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*docs_out, strict=True), arrow, strict=True)], schema=arrow)
        if far_n:
            none = [pa.nulls(len(far_n), arrow.field(k).type) for k in range(1, 7)]
            yield pa.RecordBatch.from_arrays([pa.array(far_uid, pa.int64()), *none, pa.array(far_word, pa.binary()), pa.array(far_n, pa.int64())], schema=arrow)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(parts, schema)
    # A document's own row has a word that none is (it begins with a blank), so that it meets nothing and spreads out.
    joined = rows.join(scored, "word", "left")
    tf, c = F.col("tf"), F.coalesce("c", F.lit(0))
    return joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_known", tf * (c > 0).cast("int"))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.coalesce("base", tf * (F.log10(c + 1) - below))).alias("base_score"), F.sum(F.coalesce("score", tf * F.col("lp"))).alias("score"),
    ).drop("uid")


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
