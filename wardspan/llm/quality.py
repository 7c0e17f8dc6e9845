"""Quality rules: word statistics, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of words are hashed into buckets, whose number grows with the distinct words and pairs of the corpus. Two
multinomials over the buckets are estimated: one from all trusted documents, one from all documents. A text's score is the mean log ratio of its n-grams; texts below LEAST go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import map_batches, map_tasks
from wardspan.llm.words import NEWLINE, RAW_CODES, SPACE, STEP, batches_of, find_spans, hash_spans, mix, text_bytes, window_hashes
from wardspan.session import write_stage

#: The least number of buckets, and the most distinct words and pairs a bucket holds on average.
BITS = 12
BUCKETS = 1 << BITS
LOAD = 128
#: Buckets are summed in blocks of so many. So many smallest hashes tell the number of distinct ones.
BLOCK = 1 << 12
SMALLEST = 1 << 12
#: Up to so many trusted ids are looked up in the tasks; more are joined.
MOST_IDS = 1 << 23
#: Lowest mean log ratio of a kept text.
LEAST = -0.1
MIN_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngram_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word pairs of the texts, and the text each comes from."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = window_hashes(words, 2)
    inside = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    return np.concatenate([words, pairs[inside]]), np.concatenate([owner, owner[:-1][inside] if len(owner) else owner])


def buckets_of(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _words(column):
    data, offsets = text_bytes(column)
    starts, ends, bounds = find_spans(data, offsets, SPACE)
    return data, offsets, hash_spans(data, starts, ends, RAW_CODES), bounds


def _grams_of(texts):
    """Slices (first, last) of the texts with the hashes of their n-grams and the text of each."""
    for i, j in batches_of(texts):
        with np.errstate(over="ignore"):
            _, _, words, bounds = _words(texts.slice(i, j - i))
            yield i, j, *ngram_hashes(words, bounds)


def bits_for(docs: DataFrame) -> int:
    """Bits of a bucket number, so that a bucket holds at most about LOAD distinct n-grams of all documents.

    The SMALLEST smallest of evenly spread hashes tell how many there are.
    """

    def least(batches):
        found = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, grams, _ in _grams_of(batch.column("text")):
                if len(found) == SMALLEST:
                    grams = grams[grams < found[-1]]
                found = np.unique(np.concatenate([found, grams]))[:SMALLEST]
        yield {"gram": (found >> np.uint64(1)).view(np.int64)}

    found = map_tasks(docs.select("text"), least, "gram long").distinct().orderBy("gram").limit(SMALLEST).toPandas()["gram"]
    distinct = len(found) if len(found) < SMALLEST else (SMALLEST - 1) * 2.0**63 / float(found.iloc[-1])
    return max(BITS, int(np.ceil(np.log2(max(1.0, distinct / LOAD)))))


def mark_trusted(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, object]:
    """`docs` and the sorted ids of all trusted documents (broadcast); with too many ids, `docs` with a column trusted and None."""
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = write_stage(ids, "trusted-ids")
    if ids.count() > MOST_IDS:
        return docs.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left"), None
    return docs, docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)))


def bucket_counts(docs: DataFrame, trusted: DataFrame, bits: int) -> DataFrame:
    """n-gram counts over all documents (raw) and over all trusted ones (target), as 64-bit integers of BLOCK buckets a row,
    and their sums n_raw and n_target."""
    docs, known = mark_trusted(docs.select("doc_id", "text"), trusted)

    def is_good(batch) -> np.ndarray:
        if known is None:
            return np.asarray(batch.column("trusted").fill_null(False))
        ids = np.asarray(batch.column("doc_id").fill_null(0))
        at = np.minimum(np.searchsorted(known.value, ids), max(0, len(known.value) - 1))
        return (known.value[at] == ids if len(known.value) else np.zeros(len(ids), bool)) & ~np.asarray(batch.column("doc_id").is_null())

    def packed(counts: np.ndarray) -> bytes:
        return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"u{len(data) // BLOCK}").astype(np.int64)

    def count(batches):
        raw, target = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

        def blocks():
            for k in np.flatnonzero(raw.reshape(-1, BLOCK).any(axis=1)).tolist():
                a, b = raw[k * BLOCK : (k + 1) * BLOCK], target[k * BLOCK : (k + 1) * BLOCK]
                yield {"block": [k], "raw": [packed(a)], "target": [packed(b)]}

        held = 0
        for batch in batches:
            good = is_good(batch)
            for i, j, grams, owner in _grams_of(batch.column("text")):
                if held + len(grams) >= 1 << 31:
                    yield from blocks()
                    raw[:] = target[:] = held = 0
                held += len(grams)
                for counts, part in ((raw, grams), (target, grams[good[i:j][owner]])):
                    at, n = np.unique(buckets_of(part, bits), return_counts=True)
                    counts[at] += n.astype(np.int32)
        yield from blocks()

    schema = "block long, raw binary, target binary, n_raw long, n_target long"

    def add(block: tuple, table: pa.Table) -> pa.Table:
        raw, target = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        for a, b in zip(table["raw"].to_pylist(), table["target"].to_pylist(), strict=True):
            raw += unpacked(a)
            target += unpacked(b)
        columns = [[block[0].as_py()], [raw.tobytes()], [target.tobytes()], [int(raw.sum())], [int(target.sum())]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "raw", "target", "n_raw", "n_target"])

    counted = map_tasks(docs, count, "block long, raw binary, target binary")
    return counted.groupBy("block").applyInArrow(add, schema)


def log_ratios(raw: np.ndarray, target: np.ndarray, buckets: int | None = None, totals: tuple[int, int] | None = None) -> np.ndarray:
    """Log of trusted over raw probability per bucket. The raw distribution, as strong as `prior` words, smooths the
    trusted one, so that rare n-grams and an empty trusted set give ratios near 0. For a part of the buckets, `buckets`
    and `totals` tell the whole."""
    prior = float(buckets or len(raw))
    n_raw, n_target = totals or (raw.sum(), target.sum())
    share = (raw + 1) / (n_raw + prior)
    return np.log((target + prior * share) / (n_target + prior) / share)


def _repeated_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    n = len(words)
    if n < 3:
        return np.zeros(len(bounds) - 1, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    windows = mix(window_hashes(words, 3) * STEP + owner[:-2])
    inside = owner[:-2] == owner[2:]
    at = np.flatnonzero(inside)
    _, which, counts = np.unique(windows[at], return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at[counts[which] > 1] + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[bounds])


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    starts, ends, bounds = find_spans(data, offsets, NEWLINE)
    inked = np.concatenate([[0], np.cumsum(~SPACE[data])])
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    full = inked[ends] > inked[starts]
    keys = mix(hash_spans(data, starts[full], ends[full], RAW_CODES) * STEP + owner[full])
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return np.bincount(owner[full][again].astype(np.int64), minlength=len(offsets) - 1)


def judge(texts: pa.Array, ratios: np.ndarray) -> dict:
    data, offsets, words, bounds = _words(texts)
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    grams, owner = ngram_hashes(words, bounds)
    grams = buckets_of(grams, len(ratios).bit_length() - 1)
    count = np.bincount(owner, minlength=len(texts))
    score = np.bincount(owner, weights=ratios[grams], minlength=len(texts)) / np.maximum(count, 1)
    n_words, repeated = np.diff(bounds), _repeated_words(words, bounds)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    return {
        "n_words": n_words,
        "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": _repeated_lines(data, offsets),
        "n_repeat_words": repeated,
        "log_ratio": score,
        "base_failed": failed,
        "kept": ~failed & (np.round(score, 9) >= LEAST),
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ratio double, base_failed boolean, kept boolean"


def fit_ratios(docs: DataFrame, trusted: DataFrame):
    """Broadcast log ratios per bucket: 4 bytes for each, so 4 / LOAD to 8 / LOAD bytes for every distinct n-gram."""
    bits = bits_for(docs)
    counts = write_stage(bucket_counts(docs, trusted, bits), "ngram-counts")
    sums = counts.agg(F.sum("n_raw"), F.sum("n_target")).first()
    totals = (sums[0] or 0, sums[1] or 0)

    def weigh(batch):
        pairs = zip(batch.column("raw").to_pylist(), batch.column("target").to_pylist(), strict=True)
        parts = [log_ratios(np.frombuffer(raw, np.int64), np.frombuffer(target, np.int64), 1 << bits, totals) for raw, target in pairs]
        yield {"block": batch.column("block"), "part": [p.astype(np.float32).tobytes() for p in parts]}

    nothing = log_ratios(np.zeros(1), np.zeros(1), 1 << bits, totals)[0]
    ratios = np.full((1 << bits) // BLOCK * BLOCK, nothing, np.float32).reshape(-1, BLOCK)
    for row in map_batches(counts, weigh, "block long, part binary").toLocalIterator():
        ratios[row["block"]] = np.frombuffer(row["part"], np.float32)
    return docs.sparkSession.sparkContext.broadcast(ratios.reshape(-1))


def quality_rules(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Judge every document by word statistics and by its likeness to trusted text.

    `docs` needs doc_id and text, `trusted` doc_id; other columns are ignored. The trusted distribution comes from
    all trusted documents, the raw one from all documents. Returns one row per row:
    doc_id, the columns of SCHEMA (log_ratio is the mean log ratio, 0 for a text without words). Null and empty texts
    have no words, so they fail. Without trusted documents every ratio is 0 and only the word statistics decide. Each
    repeated row counts; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = fit_ratios(docs, trusted)

    def work(batch):
        texts = batch.column("text")
        for i, j in batches_of(texts):
            with np.errstate(over="ignore"):
                yield {"doc_id": batch.column("doc_id").slice(i, j - i), **judge(texts.slice(i, j - i), ratios.value)}

    return map_batches(docs, work, f"doc_id long, {SCHEMA}")


def passing(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that `quality_rules` keeps."""
    ratios = fit_ratios(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted)

    def work(batches):
        for batch in batches:
            kept = [np.zeros(0, bool)]
            for i, j in batches_of(batch.column("text")):
                with np.errstate(over="ignore"):
                    kept.append(judge(batch.column("text").slice(i, j - i), ratios.value)["kept"])
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(work, docs.schema)
