"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus give IDF weights.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a latent space.
3. Short and long windows of every document are projected; those whose cosine with a passage, estimated in the latent
   space, reaches what the least confirmed share of the passage can leave (`least_cosine`) are candidates.
4. A candidate counts if the longest common subsequence with the passage covers enough of its words, and enough of its
   answer, the last third.
The benchmark is the query set: its passages go to all tasks in blocks of ITEMS_PER_BLOCK items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import map_batches, map_tasks
from wardspan.llm.words import LOWER_CODES, SPACE, batches_of, find_spans, hash_spans, text_bytes, word_hashes

#: The least bits of a bucket number, and the most distinct words a bucket holds on average.
BITS, LOAD = 15, 32
#: So many smallest hashes tell the number of distinct words.
SMALLEST = 1 << 12
RANK, SPARE, ROUNDS = 128, 16, 3
#: Windows of 16 and 32 words begin at every 8th word.
STRIDE, WINDOWS = 8, (16, 32)
WINDOW = max(WINDOWS)
PASSAGE, PASSAGE_STRIDE, LONG_ITEM = 48, 24, 64
#: Part of the expected cosine that rarer words around a copy may take away.
SLACK = 0.5
LEAST_SHARE, SHORT_SHARE, SHORT = 0.6, 0.9, 12
LEAST_ANSWER = 0.5
ITEMS_PER_BLOCK = 5_000
WORD = re.compile(r"\w+")


def buckets_of(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def _words_of(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column("text")
        for i, j in batches_of(texts):
            with np.errstate(over="ignore"):
                yield word_hashes(texts.slice(i, j - i), lower=True)


def bits_for(docs: DataFrame) -> int:
    """Bits of a bucket number, so that a bucket holds at most about LOAD distinct words at every size of the corpus."""

    def least(batches):
        found = np.zeros(0, np.uint64)
        for words, _ in _words_of(batches):
            if len(found) == SMALLEST:
                words = words[words < found[-1]]
            found = np.unique(np.concatenate([found, words]))[:SMALLEST]
        yield {"word": (found >> np.uint64(1)).view(np.int64)}

    found = map_tasks(docs.select("text"), least, "word long").distinct().orderBy("word").limit(SMALLEST).toPandas()["word"]
    distinct = len(found) if len(found) < SMALLEST else (SMALLEST - 1) * 2.0**63 / float(found.iloc[-1])
    return max(BITS, int(np.ceil(np.log2(max(1.0, distinct / LOAD)))))


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many documents each bucket has a word, and how many documents there are."""
    size = 1 << bits

    def count(batches):
        found, n = np.zeros(size, np.int64), 0
        for words, bounds in _words_of(batches):
            texts = len(bounds) - 1
            keys = np.sort((np.repeat(np.arange(texts, dtype=np.int64), np.diff(bounds)) << bits) | buckets_of(words, bits))
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            np.add.at(found, keys[fresh] & (size - 1), 1)
            n += texts
        at = np.flatnonzero(found)
        yield {"bucket": np.append(at, -1), "n": np.append(found[at], n)}

    sums = map_tasks(docs.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(size + 1, np.int64)
    found[sums["bucket"]] = sums["n"]
    return found[:-1], int(found[-1])


def inverse_frequencies(found: np.ndarray, n: int) -> np.ndarray:
    """IDF weights of 2**bits buckets, near 0 for words of most documents."""
    return np.log((n + 1.0) / (np.minimum(found, n) + 0.5)).astype(np.float32)


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def passages_of(text: str | None) -> list[str]:
    """The text itself, or windows of PASSAGE words of a long one."""
    words = (text or "").split()
    if len(words) <= LONG_ITEM:
        return [" ".join(words)] if words else []
    starts = [*range(0, len(words) - PASSAGE, PASSAGE_STRIDE), len(words) - PASSAGE]
    return [" ".join(words[s : s + PASSAGE]) for s in starts]


def bits_of(idf: np.ndarray) -> int:
    return len(idf).bit_length() - 1


def tf_idf(texts, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse unit rows (buckets, weights)."""
    with np.errstate(over="ignore"):
        words, bounds = word_hashes(pa.array(texts, pa.large_string()), lower=True)
    rows = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        at, counts = np.unique(buckets_of(words[first:last], bits_of(idf)), return_counts=True)
        weights = counts * idf[at].astype(np.float64)
        rows.append((at, weights / max(np.sqrt((weights**2).sum()), 1e-12)))
    return rows


def latent_space(passages: DataFrame, idf: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The RANK leading right singular vectors (a row for each of the `known` buckets) of the TF-IDF rows of `passages`
    (column text), whose sorted distinct buckets are `known`.

    Subspace iteration from a random start: each round sums a' (a W) over the rows a in their tasks, and the buckets'
    sums over the tasks; only the sums of the benchmark's own buckets reach the driver.
    """
    if not len(known):
        return np.zeros((0, 1), np.float32)
    context = passages.sparkSession.sparkContext
    width = min(RANK + SPARE, len(known))
    basis = np.random.default_rng(6).standard_normal((len(known), width)).astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(basis)[0]
        shared = context.broadcast((basis, idf, known))

        def product(batches, shared=shared):
            w, weights, known = shared.value
            total = {}
            for batch in batches:
                for buckets, a in tf_idf(batch.column("text").to_pylist(), weights):
                    at = np.searchsorted(known, buckets)
                    y = (a @ w[at]).astype(np.float64)
                    for k, x in zip(at.tolist(), a.tolist(), strict=True):
                        total[k] = total[k] + x * y if k in total else x * y
            ats = np.array(list(total), np.int64)
            flat = np.concatenate([*total.values(), np.zeros(0)])
            offsets = np.arange(0, flat.size + 1, width, dtype=np.int32) if len(ats) else np.zeros(1, np.int32)
            yield {"bucket": ats, "part": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

        parts = map_tasks(passages.select("text"), product, "bucket long, part array<double>")
        sums = parts.select("bucket", F.posexplode("part").alias("k", "x")).groupBy("bucket", "k").agg(F.sum("x").alias("x"))
        rows = sums.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("part")).orderBy("bucket").toPandas()
        product_of = np.zeros((len(known), width))
        if len(rows):
            product_of[rows["bucket"]] = np.stack(rows["part"])
        shared.unpersist()
        projected = basis.T.astype(np.float64) @ product_of
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        best = np.argsort(-values)[:RANK]
        best = best[values[best] > 1e-9]
        leading, basis = basis @ turn[:, best], product_of.astype(np.float32) + 1e-9 * basis
    return leading.astype(np.float32)


class Passage:
    """A benchmark passage prepared for the search of common subsequences: the positions of a word as bits."""

    def __init__(self, words: list[str]):
        self.words = words
        answer = words[-max(1, len(words) // 3) :]
        needed = (LEAST_SHARE if len(words) >= SHORT else SHORT_SHARE) * len(words)
        self.parts = [(self.places(words), len(words), needed), (self.places(answer), len(answer), LEAST_ANSWER * len(answer))]

    @staticmethod
    def places(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, word in enumerate(words):
            out[word] = out.get(word, 0) | 1 << k
        return out

    def share(self, text: list[str]) -> float:
        """Share of the passage found in the text in order; 0 if that is too little or its answer is missing."""
        lengths = []
        for places, n, needed in self.parts:
            lengths.append(common_subsequence(places, n, text))
            if not lengths[-1] or lengths[-1] < needed:
                return 0.0
        return lengths[0] / len(self.words)


def least_cosine(n: int, width: int) -> float:
    """Cosine of a passage of n words with a window of `width` words that holds the least confirmed share of it, were all
    words of equal weight, times SLACK."""
    share = LEAST_SHARE if n >= SHORT else SHORT_SHARE
    return SLACK * share * min(n, width) / np.sqrt(max(1, n) * width)


def widened(blocks: np.ndarray, owner: np.ndarray, by: int) -> np.ndarray:
    """Each row plus the one `by` rows later, if it is of the same text."""
    out = blocks.copy()
    if len(out) > by:
        same = owner[by:] == owner[:-by]
        out[:-by][same] += blocks[by:][same]
    return out


def common_subsequence(places: dict[str, int], n: int, text: list[str]) -> int:
    """Length of the longest common subsequence of a text and the n words with these places."""
    full = row = (1 << n) - 1
    for place in [places[word] for word in text if word in places]:
        hit = row & place
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


@dataclass
class Screen:
    """What a task needs to find one block of the benchmark.

    `latent` holds z / |z|**2 of each passage's projection z, so that its product with a window's projection, divided by
    the window's full norm, estimates the cosine of the two TF-IDF rows however much of them the space holds. `space` has
    the IDF-weighted singular vectors of the benchmark's buckets after a row of zeros, `slot` the row of every bucket.
    """

    space: np.ndarray
    slot: np.ndarray
    idf: np.ndarray
    items: list
    passages: list[Passage]
    latent: np.ndarray

    def candidates(self, sums: np.ndarray, squares: np.ndarray, owner: np.ndarray, prune: bool = True) -> tuple[np.ndarray, ...]:
        """(block, passage, cosine) of every window whose cosine reaches the passage's bound, by passage and block.

        `sums` and `squares` are the projections and squared norms of the blocks of STRIDE words, `owner` their texts. By
        Cauchy-Schwarz a window reaches no bound if its projection times the largest |latent row| / bound is shorter than
        its own norm; with `prune` such windows are left out of the product with the passages, which loses none.
        """
        size, beyond = 4096, WINDOW // STRIDE
        bounds = [np.array([least_cosine(len(p.words), width) for p in self.passages], np.float32) for width in WINDOWS]
        scaled = [self.latent / bound[:, None] for bound in bounds]
        reach = [float((rows.astype(np.float64) ** 2).sum(axis=1).max()) for rows in scaled]
        found = []
        for k in range(0, len(owner), size):
            own, part, norms = (x[k : k + size + beyond] for x in (owner, sums, squares))
            by = 1
            for width, bound, rows, most in zip(WINDOWS, bounds, scaled, reach, strict=True):
                while by * STRIDE < width:
                    part, norms, by = widened(part, own, by), widened(norms, own, by), 2 * by
                window, norm = part[:size], norms[:size]
                live = np.arange(len(window))
                if prune:
                    live = np.flatnonzero(np.einsum("ij,ij->i", window, window) * (most * 1.001) >= norm)
                near = (window[live] / np.maximum(np.sqrt(norm[live]), 1e-6)[:, None]) @ rows.T
                row, passage = np.divmod(np.flatnonzero(near >= 1), len(self.passages))
                found.append((passage * len(owner) + k + live[row], near[row, passage] * bound[passage]))
        keys, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        cosines = np.maximum.reduceat(cosines[order], first) if len(keys) else cosines
        passage, block = np.divmod(keys, len(owner))
        return block, passage, cosines

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float]]:
        """(text, passage, cosine, share) of every confirmed passage; the best cosine of its candidate windows."""
        data, offsets = text_bytes(texts)
        starts, ends, bounds = find_spans(data, offsets, SPACE)
        if not len(starts) or not len(self.passages):
            return
        with np.errstate(over="ignore"):
            at = buckets_of(hash_spans(data, starts, ends, LOWER_CODES), bits_of(self.idf))
        n_blocks = -(-np.diff(bounds) // STRIDE)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        first_block = np.concatenate([[0], np.cumsum(n_blocks)])
        block_starts = bounds[owner] + STRIDE * (np.arange(len(owner)) - first_block[owner])
        squares = np.add.reduceat(self.idf[at] ** 2, block_starts)
        sums = self.projections(self.slot[at], block_starts, bounds[owner + 1])
        block, passage, cosine = self.candidates(sums, squares, owner)
        if not len(block):
            return
        opens = np.ones(len(block), bool)
        opens[1:] = (passage[1:] != passage[:-1]) | (block[1:] != block[:-1] + 1) | (owner[block[1:]] != owner[block[:-1]])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(block)) - 1
        best = np.maximum.reduceat(cosine, first)
        text, which = owner[block[first]], passage[first]
        block_ends = np.append(block_starts[1:], len(starts))
        held: list[list[str] | None] = [None] * len(owner)

        def tokens_of(b: int) -> list[str]:
            if held[b] is None:
                held[b] = tokens(bytes(data[starts[block_starts[b]] : ends[block_ends[b] - 1]]).decode("utf-8", "replace"))
            return held[b]

        done = None
        for k in np.lexsort((-best, which, text)).tolist():
            t, p = int(text[k]), int(which[k])
            if done == (t, p):
                continue
            reach = -(-len(self.passages[p].words) // STRIDE)
            low = max(int(first_block[t]), int(block[first[k]]) - reach)
            high = min(int(first_block[t + 1]), int(block[last[k]]) + WINDOW // STRIDE + reach)
            share = self.passages[p].share(list(chain.from_iterable(map(tokens_of, range(low, high)))))
            if share:
                done = t, p
                yield t, p, float(best[k]), share

    def projections(self, slots: np.ndarray, block_starts: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        """Sum of the rows of `space` over the words of each block; no block goes beyond its text."""
        sums = np.zeros((len(block_starts), self.space.shape[1]), np.float32)
        row = np.empty((1024, self.space.shape[1]), np.float32)
        for k in range(0, len(sums), 1024):
            place = block_starts[k : k + 1024, None] + np.arange(STRIDE)
            inside = place < text_ends[k : k + 1024, None]
            part = sums[k : k + 1024]
            for column in np.where(inside, slots[np.minimum(place, len(slots) - 1)], 0).T:
                part += np.take(self.space, column, axis=0, out=row[: len(part)], mode="clip")
        return sums


def screens(docs: DataFrame, benchmark: DataFrame) -> list[Screen]:
    """One screen per block of benchmark items."""
    found, n = document_frequencies(docs, bits_for(docs))
    idf = inverse_frequencies(found, n)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        pairs = [(row["item_id"], p) for row in rows for p in passages_of(row["text"])]
        table = docs.sparkSession.createDataFrame([(p,) for _, p in pairs], "text string")
        rows = tf_idf([p for _, p in pairs], idf) if pairs else []
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *[at for at, _ in rows]]))
        space = latent_space(table, idf, known)
        latent = np.zeros((len(pairs), space.shape[1]), np.float32)
        for k, (at, a) in enumerate(rows):
            z = a @ space[np.searchsorted(known, at)]
            latent[k] = z / max((z**2).sum(), 1e-12)
        slot = np.zeros(len(idf), np.int32)
        slot[known] = np.arange(1, len(known) + 1)
        weighted = np.vstack([np.zeros((1, space.shape[1])), space * idf[known, None]]).astype(np.float32)
        out.append(Screen(weighted, slot, idf, [i for i, _ in pairs], [Passage(tokens(p)) for _, p in pairs], latent))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, cosine, share, one row per document row and item.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are ignored. cosine is the best latent
    cosine of the item's passages, share the part of the passage found in order. Null and empty texts hold nothing, null
    and empty items are never found. Repeated document rows are reported each; repeated items once per item_id. An empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for screen in screens(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(screen)

        def work(batch, shared=shared):
            for i, j in batches_of(batch.column("text")):
                ids = batch.column("doc_id").slice(i, j - i)
                best = {}
                for text, p, cosine, share in shared.value.leaks(batch.column("text").slice(i, j - i)):
                    key = text, shared.value.items[p]
                    best[key] = max(best.get(key, (0.0, 0.0)), (cosine, share))
                if best:
                    yield {
                        "doc_id": ids.take(pa.array([t for t, _ in best])),
                        "item_id": [i for _, i in best],
                        "cosine": [c for c, _ in best.values()],
                        "share": [s for _, s in best.values()],
                    }

        part = map_batches(docs, work, "doc_id long, item_id long, cosine double, share double")
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, in which no benchmark item is found (see `find_leaks`)."""
    out = docs
    for screen in screens(docs.select("text"), benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(screen)

        def work(batches, shared=shared):
            for batch in batches:
                texts = batch.column("text")
                clean = np.ones(len(texts), bool)
                for i, j in batches_of(texts):
                    for text, *_ in shared.value.leaks(texts.slice(i, j - i)):
                        clean[i + text] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(work, docs.schema)
    return out
