"""Lexical retrieval packing: documents that share rare tokens are packed into the same training window.

Documents are laid in a lexical order and cut into shards of about SHARD_IDS token ids: first by the nearest of some
centroids of their TF-IDF vectors (fitted on a bounded sample, in a chain of near ones), then by a weighted MinHash token;
documents alike in both are spread by a hash, so that no shard grows with the number of copies. Each shard holds a BM25
inverted index over its documents' token ids, weighted by document frequencies of the whole corpus. A seed document
queries the index with its rarest tokens; its unused neighbours, best first, fill the rest of its window, and the one
that crosses the end is cut there and seeds the next window. What is left at the end of a shard is cut into lengths
that are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspan.llm.encoder import encoder, vocabulary_path
from wardspan.llm.tables import distinct_texts, map_tasks, picked
from wardspan.llm.words import batches_of
from wardspan.operators.scale import lookup_join
from wardspan.session import write_stage

WINDOW = 2048
END_ID = 1
SHARD_IDS = 2 << 20
QUERY_TERMS = 16
K1, B = 1.2, 0.75
SEQUENCES = 1 << 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
#: The centroids are fitted to the vectors of at most so many distinct texts.
SAMPLE_DOCS = 4_000
CENTROIDS, RANK = 64, 48


@lru_cache(maxsize=2)
def projection(size: int) -> np.ndarray:
    """A random direction for each token."""
    return np.random.default_rng(10).normal(size=(size, RANK)).astype(np.float32)


@lru_cache(maxsize=2)
def chances(size: int) -> np.ndarray:
    """An exponential number for each token; the least, divided by the weights, makes the weighted MinHash."""
    return np.random.default_rng(11).exponential(size=size)


def vector_and_mark(ids: np.ndarray, idf: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The projected TF-IDF vector of a document (length 1 or 0) and its weighted MinHash token; its terms are added to `total`."""
    terms, counts = np.unique(ids, return_counts=True)
    if total is not None:
        total[terms] += 1
    weights = np.log1p(counts) * idf[terms]
    vector = weights.astype(np.float32) @ projection(len(idf)).take(terms, 0)
    mark = terms[np.argmin(chances(len(idf))[terms] / np.maximum(weights, 1e-12))]
    return vector / max(float(np.linalg.norm(vector)), 1e-12), int(mark)


def centroids_of(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, begun at the first `k` vectors; the centroids in a chain, each next to the nearest one left."""
    centres = vectors[:k].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = vectors[own == j].mean(axis=0)
                centres[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    chain, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, centres @ centres[chain[-1]], -np.inf).argmax()))
        left[chain[-1]] = False
    return centres[chain]


class Bm25Index:
    """Inverted index of the token ids of a shard's documents, built by one stable sort; `idf` has a weight for each id."""

    def __init__(self, stream: np.ndarray, lengths: np.ndarray, idf: np.ndarray):
        n = len(lengths)
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        order = np.argsort(stream, kind="stable")
        tokens, owner = stream[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(tokens))).astype(np.float32)
        self.docs, terms = owner[at], tokens[at].astype(np.int64)
        self.first = np.searchsorted(terms, np.arange(int(terms.max(initial=0)) + 2))
        df = np.diff(self.first)
        norm = (K1 * (1 - B + B * lengths / max(lengths.mean(), 1))).astype(np.float32)
        self.weights = idf[terms] * counts * np.float32(K1 + 1) / (counts + norm[self.docs])
        by_doc = np.argsort(self.docs, kind="stable")
        self.terms, self.term_at = terms[by_doc], np.searchsorted(self.docs[by_doc], np.arange(n + 1))
        self.df, self.idf, self.n = df, idf, n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's QUERY_TERMS rarest shared tokens, best score first."""
        terms = self.terms[self.term_at[seed] : self.term_at[seed + 1]]
        terms = terms[self.df[terms] > 1]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[:QUERY_TERMS]]
        if not len(terms):
            return terms
        ranges = [slice(self.first[t], self.first[t + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.docs[r] for r in ranges]), np.concatenate([self.weights[r] for r in ranges]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def arrange(stream: np.ndarray, lengths: np.ndarray, idf: np.ndarray, window: int) -> list[int]:
    """The order in which a shard's documents are laid one after another."""
    index, unused, order = Bm25Index(stream, lengths, idf), np.ones(len(lengths), bool), []
    filled = following = 0

    def lay(doc: int) -> None:
        nonlocal filled
        unused[doc] = False
        order.append(doc)
        filled += int(lengths[doc])

    while len(order) < len(lengths):
        end = -(-filled // window) * window
        if filled < end:
            for doc in index.neighbours(order[-1], unused):
                if filled >= end:
                    break
                lay(int(doc))
        if filled <= end and len(order) < len(lengths):
            while not unused[following]:
                following += 1
            lay(following)
    return order


def sequence_starts(total: int, window: int) -> np.ndarray:
    """Starts of the sequences of `total` ids: whole windows, then powers of two, largest first."""
    starts = list(range(0, total - total % window + 1, window))
    rest = total % window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        starts.append(starts[-1] + size)
    return np.array(starts[:-1] if len(starts) > 1 else starts, np.int64)


def pack_shard(each: list[np.ndarray], idf: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Pieces of one shard's documents (ids): document, start, length, crc, tokens, sequence, offset and the ids themselves."""
    lengths = np.array([len(ids) for ids in each], np.int64)
    joined = np.concatenate(each)
    order = np.array(arrange(joined, lengths, idf, window), np.int64)
    stream = np.concatenate([each[k] for k in order]).astype("<u4")
    doc_starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    cuts = sequence_starts(len(stream), window)
    starts = np.union1d(doc_starts, cuts)
    ends = np.append(starts[1:], len(stream))
    place = np.searchsorted(doc_starts, starts, "right") - 1
    sequence = np.searchsorted(cuts, starts, "right") - 1
    raw = memoryview(stream.tobytes())
    parts = [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
    return {
        "row": order[place],
        "start": starts - doc_starts[place],
        "length": ends - starts,
        "ids_crc32": np.array([zlib.crc32(p) for p in parts], np.int64),
        "doc_tokens": lengths[order[place]],
        "sequence": sequence,
        "offset": starts - cuts[sequence],
        "ids": [bytes(p) for p in parts],
    }


def ids_of(text: str | None, path: str, width: str) -> np.ndarray:
    """The ids of a text and END_ID."""
    ids = encoder(path).ids(text or "")
    ids.append(END_ID)
    return np.fromiter(ids, width, len(ids))


def sums_of(found: np.ndarray) -> dict[str, np.ndarray]:
    at = np.flatnonzero(found)
    return {"id": at, "n": found[at]}


def frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """IDF of every id below `size` from counts (id, n); id `size` counts the documents. Bounded by the vocabulary."""
    sums = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1)
    df[sums["id"]] = sums["n"]
    return np.log1p((df[-1] - df[:-1] + 0.5) / (df[:-1] + 0.5)).astype(np.float32)


def fit_order(docs: DataFrame, path: str, size: int, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """IDF weights and centroids of the lexical order, from about `sample_docs` distinct texts picked by a hash."""
    order = F.xxhash64(F.lit(12), "text")
    sample = docs.select("text").where(picked(order, distinct_texts(docs, order), sample_docs)).distinct()

    def encode(batches):
        for batch in batches:
            each = [ids_of(text, path, "<u4").tobytes() for text in batch.column("text").to_pylist()]
            yield {"tie": batch.column("tie"), "ids": each}

    def count(batches):
        found = np.zeros(size + 1, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                found[np.unique(np.frombuffer(ids, "<u4"))] += 1
                found[size] += 1
        yield sums_of(found)

    coded = write_stage(map_tasks(sample.select(order.alias("tie"), "text"), encode, "tie long, ids binary"), "packing-sample")
    idf = frequencies(map_tasks(coded.select("ids"), count, "id long, n long"), size)
    known = docs.sparkSession.sparkContext.broadcast(idf)

    def project(batches):
        for batch in batches:
            found = [vector_and_mark(np.frombuffer(ids, "<u4"), known.value)[0] for ids in batch.column("ids").to_pylist()]
            yield {"tie": batch.column("tie"), "vector": [v.tobytes() for v in found]}

    taken = map_tasks(coded, project, "tie long, vector binary").orderBy("tie", "vector").limit(sample_docs).collect()
    vectors = np.stack([np.frombuffer(row["vector"], np.float32) for row in taken]) if taken else np.zeros((1, RANK), np.float32)
    return idf, centroids_of(vectors)


def encoded(docs: DataFrame, path: str, size: int, width: str, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, np.ndarray]:
    """Every row as doc_id, tie (text hash), copy (number among equal rows of a task), n, ids, cell (the place of the
    nearest centroid in the chain) and mark (the MinHash token), written in one pass; and the IDF over all documents.

    Each task adds one row with the document frequencies of its rows, so that the ids need not be read for them.
    """
    known = docs.sparkSession.sparkContext.broadcast(fit_order(docs, path, size, sample_docs))

    def encode(batches):
        idf, centres = known.value
        seen: Counter[tuple] = Counter()
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for i, j in batches_of(texts):
                each = [ids_of(text, path, width) for text in texts.slice(i, j - i).to_pylist()]
                found = [vector_and_mark(ids, idf, total) for ids in each]
                total[size] += len(each)
                doc_id, tie = (batch.column(c).slice(i, j - i) for c in ("doc_id", "tie"))
                copies = []
                for key in zip(doc_id.to_pylist(), tie.to_pylist(), strict=True):
                    copies.append(seen[key])
                    seen[key] += 1
                cells = (np.stack([v for v, _ in found]) @ centres.T).argmax(axis=1)
                yield {
                    "doc_id": doc_id, "tie": tie, "copy": copies, "n": [len(ids) for ids in each], "ids": [ids.tobytes() for ids in each],
                    "cell": cells, "mark": [m for _, m in found], "counted": pa.nulls(len(each)),
                }
        sums = sums_of(total)
        pairs = [{"id": int(k), "n": int(n)} for k, n in zip(sums["id"], sums["n"], strict=True)]
        yield {**{c: pa.nulls(1) for c in ("doc_id", "tie", "copy", "n", "ids", "cell", "mark")}, "counted": [pairs]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(10), "text").alias("tie"), "text")
    schema = "doc_id long, tie long, copy long, n long, ids binary, cell int, mark int, counted array<struct<id: long, n: long>>"
    stage = write_stage(map_tasks(rows, encode, schema), "packing-ids")
    idf = frequencies(stage.where("counted IS NOT NULL").select(F.inline("counted")), size)
    return stage.where("counted IS NULL").drop("counted"), idf


def dealt(rows: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """`rows` with shard: the ids are laid by cell and mark, each document at a hashed place among those alike, and cut.

    The totals are sums per cell and mark; a cell has one row for each id of the vocabulary at most.
    """
    sizes = rows.groupBy("cell", "mark").agg(F.sum("n").alias("size"))
    inside = Window.partitionBy("cell").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    sizes = write_stage(sizes.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))), "packing-sizes")
    totals = {row["cell"]: row["size"] for row in sizes.groupBy("cell").agg(F.sum("size").alias("size")).collect()}
    offsets = np.concatenate([[0], np.cumsum([totals.get(c, 0) for c in range(max(totals, default=0) + 1)])]).tolist()
    begun = sizes.withColumn("before", F.col("before") + F.get(F.array(*map(F.lit, offsets)), F.col("cell")))
    share = F.pmod(F.xxhash64("doc_id", "tie", "copy"), F.lit(1 << 52)) / F.lit(2.0**52)
    shard = F.floor((F.col("before") + share * F.col("size")) / F.lit(shard_ids)).cast("long")
    return lookup_join(rows, begun, ["cell", "mark"], "inner").withColumn("shard", shard).drop("cell", "mark", "before", "size", "copy")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = True, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pack all documents into sequences of at most `window` ids; one row per piece (SCHEMA).

    Needs doc_id and text, ignores other columns. A document's ids are those of the vocabulary file plus END_ID, so a
    null or empty text is one id. Every id lies in one piece; pieces lie in their sequence without gaps, and a sequence
    is either full or as long as a power of two. Repeated rows and rows without doc_id are documents of their own; equal
    rows are spread over the shards that their ids need. Equal scores are taken in the order of doc_id and text hash. An
    empty table gives an empty table. `with_ids=False` leaves the ids out (null).
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    size = max(encoder(path).size, END_ID + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows, idf = encoded(docs, path, size, width)
    known = docs.sparkSession.sparkContext.broadcast(idf)

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["doc_id", "tie", "n", "ids", "shard"]).sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("n", "ascending")]).combine_chunks()
        pieces = pack_shard([np.frombuffer(ids, width) for ids in table["ids"].to_pylist()], known.value, window)
        shard = table["shard"][0].as_py()
        ids = pa.array(pieces["ids"], pa.binary()) if with_ids else pa.nulls(len(pieces["row"]), pa.binary())
        columns = [table["doc_id"].combine_chunks().take(pa.array(pieces["row"])), *[pa.array(pieces[c]) for c in ("start", "length", "ids_crc32", "doc_tokens")]]
        columns += [pa.array(pieces["sequence"] + shard * SEQUENCES), pa.array(pieces["offset"]), ids]
        return pa.table(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return dealt(rows, shard_ids).groupBy("shard").applyInArrow(run, SCHEMA)
