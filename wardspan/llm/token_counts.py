"""Token counts by a two-tier lookup inside the map tasks; nothing is shuffled.

Tier one is a broadcast table with the lengths (in tokens) of frequent pre-tokens, found in a bounded sample. Tier two is
a bounded cache of each worker, which encodes what the table lacks. The tables only save work: a count never depends on
what they hold.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.encoder import Encoder, encoder, pre_token_pattern, vocabulary_path
from wardspan.llm.tables import distinct_texts, map_batches, map_tasks, picked

LIMIT = 512
#: Documents (in the order of a hash) whose pre-tokens are counted for the table, and its entries.
SAMPLE_DOCS = 2_000
FREQUENT = 50_000
MOST_CACHED = 300_000


@lru_cache(maxsize=1)
def pre_tokens():
    return regex.compile(pre_token_pattern())


class Lengths(dict):
    """Tokens of a pre-token: the frequent ones, and a cache of others that starts anew when it is full."""

    def __init__(self, frequent: dict[str, int], encode: Encoder):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode.ranks.encode_ordinary(piece))
        if len(self) >= len(self.frequent) + MOST_CACHED:
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.encode.usual(text):
            return len(self.encode.ids(text))
        return sum(map(self.__getitem__, pre_tokens().findall(text)))


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about `sample_docs` distinct texts, picked by a hash."""
    order = F.xxhash64(F.lit(4), "text")
    sample = docs.select("text").where(picked(order, distinct_texts(docs, order), sample_docs)).distinct()

    def count(batches):
        seen: Counter[str] = Counter()
        encode = encoder(path)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and encode.usual(text):
                    seen.update(pre_tokens().findall(text))
        best = seen.most_common(most)
        yield {"piece": [p for p, _ in best], "n": [n for _, n in best]}

    counted = map_tasks(sample, count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "piece").limit(most).collect()
    encode = encoder(path)
    return {row["piece"]: len(encode.ranks.encode_ordinary(row["piece"])) for row in rows}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Needs doc_id and text, ignores other columns. Counts equal those of the `tokenizers` library for the vocabulary file
    (byte-level), without added special tokens, strings of special tokens inside a text being one token each. Null and
    empty texts have no bytes and no tokens. Repeated rows are counted each; an empty table gives an empty table.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    cached: dict[str, Lengths] = {}

    def work(batch):
        if path not in cached:
            cached[path] = Lengths(frequent.value, encoder(path))
        counts = np.array([cached[path].count(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        yield {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": counts, "over_limit": counts > limit}

    return map_batches(docs, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
