"""Token counts by byte-pair merging with a heap and a linked list, for sentencepiece BPE vocabularies.

The adjacent pair of the lowest rank is merged again and again (ties: the leftmost); the count is the number of
initial symbols less the merges, and no identifiers are made. Words are counted apart where no piece spans their
border, and a worker keeps the counts of the short words it has met.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"


def merged_count(symbols: list[str], rank: dict[str, float], size) -> int:
    """How many tokens symbols become: size(symbol) each at first (one but for fallbacks), one less for each merge."""
    n = len(symbols)
    after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
    heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i]
        if text[i] is None or j >= n or text[i] + text[j] != piece:
            continue  # one of the two has been merged otherwise
        merges += 1
        text[i], text[j] = piece, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (p := piece + text[k]) in rank:
                heapq.heappush(heap, (rank[p], i, p))
        h = before[i]
        if h >= 0 and (p := text[h] + piece) in rank:
            heapq.heappush(heap, (rank[p], h, p))
    left_over = sum(size(s) - 1 for s in text if s is not None and len(s) == 1)
    return n - merges + left_over


class Counter(dict):
    """Chunk to count, filled as chunks are met; long chunks are counted anew each time."""

    KEPT_CHARS, KEPT = 48, 600_000

    def __init__(self, model_file: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.size = lambda s: 1 if s in self.rank or not fallback else len(s.encode())
        self.normalize = model.normalize
        self.same = all(model.normalize(x) == f" {x}".replace(" ", SPACE) for x in ("a  b", " É́ﬁ\t\n　Ａ "))
        apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.rank)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart else r"(?s).+")

    def __missing__(self, chunk: str) -> int:
        n = merged_count(list(chunk), self.rank, self.size)
        if len(chunk) <= self.KEPT_CHARS:
            if len(self) >= self.KEPT:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = f"{SPACE}{text}".replace(" ", SPACE) if self.same else self.normalize(text)
        if len(text) < 2_000_000:
            return sum(map(self.__getitem__, self.chunks.findall(text)))
        return sum(self[m.group()] for m in self.chunks.finditer(text))


@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def count_tokens(df: DataFrame, model_file: str, text: str = "text", max_tokens: int = 4096) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > max_tokens); columns of these names are replaced.

    model_file: a sentencepiece BPE model at the same path on every executor. The whole text counts, of any length,
    without begin or end tokens; strings of special tokens are ordinary text. Null and empty texts have none.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        c = counter(model_file)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": tokens(whole)})
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
