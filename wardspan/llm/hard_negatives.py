"""Hard-negative mining over rotated one-bit codes with exact intervals.

Every vector is turned by a seeded rotation and replaced by the signs of its components: one bit a component. Stored
beside the code is its alignment, the inner product of the vector with the unit vector of its signs. What the code
leaves over is coded again under the next rotation, LEVELS times, and the length of the last rest is stored.

An anchor's components are rounded to BITS bits under each rotation; popcounts of a code with the anchor's bit planes
give the inner product with the code, hence an estimate of the score. By Cauchy-Schwarz the estimate is off by at most
|rest| * |anchor| plus alignment * |rounding error| a level: an interval that always holds the score. Rows whose
interval cannot reach what an anchor has found so far are dropped; all others are scored in integers. No row is lost.

Anchors go in blocks of bounded size. Each block reads the index twice: for its positives, then for the negatives below
their bounds. A task streams its rows past the whole block and returns the best few per anchor.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspan.llm.tables import map_tasks
from wardspan.session import new_stage_path, write_stage

LEVELS = 4
BITS = 7
#: Anchors of a block, of one matrix of intervals, and rows of one matrix.
BLOCK = 4096
ANCHORS = 512
ROWS = 2048
#: Numbers gathered at once to score pairs in integers.
GATHER = 1 << 22
NONE = np.iinfo(np.int64).min


@lru_cache(maxsize=4)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(12).choice(np.array([-1.0, 1.0]), size=(LEVELS, 2, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The orthogonal Hadamard transform of each row; its own inverse. The width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    for signs in _signs(x.shape[1])[level]:
        x = _hadamard(x * signs)
    return x


def rotate_back(x: np.ndarray, level: int) -> np.ndarray:
    for signs in _signs(x.shape[1])[level][::-1]:
        x = _hadamard(x) * signs
    return x


def padded(ints: np.ndarray) -> np.ndarray:
    """Rows as doubles, filled with zeros to a power of two of 64 at least."""
    width = max(64, 1 << max(0, ints.shape[1] - 1).bit_length())
    out = np.zeros((len(ints), width))
    out[:, : ints.shape[1]] = ints
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, word), alignments (row, level) and length of the rest of each row."""
    rest = padded(ints)
    width = rest.shape[1]
    codes, alignments = [], []
    for level in range(LEVELS):
        turned = rotate(rest, level)
        up = turned >= 0
        alignment = np.abs(turned).sum(axis=1) / np.sqrt(width)
        rest = rest - alignment[:, None] * rotate_back(np.where(up, 1.0, -1.0) / np.sqrt(width), level)
        codes.append(_packed(up))
        alignments.append(alignment)
    return np.stack(codes, axis=1), np.stack(alignments, axis=1), np.linalg.norm(rest, axis=1)


@dataclass
class Anchors:
    """A block of anchors, one entry per anchor in every array."""

    vec_id: np.ndarray
    label: np.ndarray
    ints: np.ndarray

    def part(self, first: int, last: int) -> Anchors:
        return Anchors(self.vec_id[first:last], self.label[first:last], self.ints[first:last])

    def planes(self):
        """Per level: bit planes (bit, anchor, word), lowest value, step, sum of the rounded components, error; and all lengths."""
        whole = padded(self.ints)
        levels = []
        for level in range(LEVELS):
            turned = rotate(whole, level)
            low = turned.min(axis=1)
            step = (turned.max(axis=1) - low) / ((1 << BITS) - 1)
            step[step == 0] = 1.0
            rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            error = np.linalg.norm(turned - low[:, None] - step[:, None] * rounded, axis=1)
            bits = np.stack([_packed((rounded >> j & 1).astype(bool)) for j in range(BITS)])
            levels.append((bits, low, step, rounded.sum(axis=1), error))
        return levels, np.linalg.norm(whole, axis=1)


@dataclass
class Rows:
    """Some rows of the index."""

    vec_id: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    codes: np.ndarray
    alignments: np.ndarray
    rest: np.ndarray

    @staticmethod
    def chunks(batches, dim: int):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)

                def flat(name, width, part=part):
                    return part.column(name).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)

                words = max(64, 1 << max(0, dim - 1).bit_length()) // 64
                yield Rows(
                    part.column("vec_id").to_numpy(zero_copy_only=False),
                    part.column("label").to_numpy(zero_copy_only=False),
                    flat("ints", dim),
                    flat("codes", LEVELS * words).view(np.uint64).reshape(part.num_rows, LEVELS, words),
                    flat("alignments", LEVELS),
                    part.column("rest").to_numpy(zero_copy_only=False),
                )


def intervals(planes, lengths: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (anchor, row) of all scores and how far they can be off."""
    words = rows.codes.shape[2]
    width = words * 64
    estimate = np.zeros((len(lengths), len(rows.vec_id)))
    errors = np.empty((len(lengths), LEVELS))
    for level, (bits, low, step, total, error) in enumerate(planes):
        codes = rows.codes[:, level]
        hits = np.zeros(estimate.shape, np.int32)
        for j in range(BITS):
            for w in range(words):
                hits += np.bitwise_count(bits[j][:, None, w] & codes[None, :, w]).astype(np.int32) << j
        ups = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        inner = hits * (2.0 * step[:, None])
        inner -= (step * total)[:, None]
        inner += np.outer(low, 2 * ups - width)
        inner *= rows.alignments[:, level] / np.sqrt(width)
        estimate += inner
        errors[:, level] = error
    squares = np.einsum("ij,ij->i", rows.alignments, rows.alignments) + rows.rest**2
    slack = 1e-9 * np.outer(lengths, np.sqrt(squares)) + 1e-6
    return estimate, np.outer(lengths, rows.rest) + errors @ rows.alignments.T + slack


def integer_scores(anchors: Anchors, rows: Rows, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    piece = max(1, GATHER // max(1, anchors.ints.shape[1]))
    for k in range(0, len(a), piece):
        part = slice(k, k + piece)
        np.einsum("ij,ij->i", anchors.ints[a[part]].astype(np.int64), rows.ints[r[part]].astype(np.int64), out=out[part])
    return out


@dataclass
class Best:
    """The best `most` (score, vec_id) of each key, higher scores and then smaller ids first."""

    keys: int
    most: int

    def __post_init__(self):
        self.key = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.vec_id = np.zeros(0, np.int64)
        #: The score of the last place of each key, NONE while places are free.
        self.last = np.full(self.keys, NONE)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        better = score >= self.last[key]
        key, score, vec_id = (np.concatenate(pair) for pair in ((self.key, key[better]), (self.score, score[better]), (self.vec_id, vec_id[better])))
        order = np.lexsort((vec_id, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        stay = place < self.most
        self.key, self.score, self.vec_id = key[stay], score[order][stay], vec_id[order][stay]
        full = place[stay] == self.most - 1
        self.last[self.key[full]] = self.score[full]


def positives_of(anchors: Anchors, batches, dim: int, most: int):
    """The best `most` same-label rows of each anchor among a task's rows: columns key, score, vec_id."""
    parts = [(k, anchors.part(k, k + ANCHORS)) for k in range(0, len(anchors.vec_id), ANCHORS)]
    coded = [part.planes() for _, part in parts]
    best = Best(len(anchors.vec_id), most)
    for rows in Rows.chunks(batches, dim):
        for (first, part), (planes, lengths) in zip(parts, coded, strict=True):
            estimate, off = intervals(planes, lengths, rows)
            fits = (part.label[:, None] == rows.label) & (part.vec_id[:, None] != rows.vec_id)
            least = best.last[first : first + ANCHORS].astype(float)
            if (least == NONE).any() and len(rows.vec_id) > most:
                # most lower ends in this chunk are a bound before anything is scored
                low = np.where(fits, estimate - off, -np.inf)
                least = np.maximum(least, np.partition(low, -most, axis=1)[:, -most])
            a, r = np.nonzero(fits & (estimate + off >= least[:, None]))
            best.add(a + first, integer_scores(part, rows, a, r), rows.vec_id[r])
    return {"key": best.key, "score": best.score, "vec_id": best.vec_id}


@dataclass
class Slots:
    """Score ranges in which negatives are sought: anchor (index, ascending), low and high (both included)."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


def negatives_of(anchors: Anchors, slots: Slots, batches, dim: int, most: int):
    """The best `most` other-label rows of each slot among a task's rows: columns key (slot), score, vec_id."""
    parts = [(k, anchors.part(k, k + ANCHORS)) for k in range(0, len(anchors.vec_id), ANCHORS)]
    coded = [part.planes() for _, part in parts]
    best = Best(len(slots.anchor), most)
    begin = np.searchsorted(slots.anchor, np.arange(len(anchors.vec_id) + 1))
    widest = int(np.diff(begin).max(initial=0))
    highest = np.full(len(anchors.vec_id), -np.inf)
    np.maximum.at(highest, slots.anchor, slots.high)
    for rows in Rows.chunks(batches, dim):
        for (first, part), (planes, lengths) in zip(parts, coded, strict=True):
            least = np.full(len(part.vec_id), np.inf)
            here = slice(begin[first], begin[first + len(part.vec_id)])
            np.minimum.at(least, slots.anchor[here] - first, np.maximum(slots.low[here], best.last[here]))
            estimate, off = intervals(planes, lengths, rows)
            wanted = (estimate + off >= least[:, None]) & (estimate - off <= highest[first : first + ANCHORS, None])
            a, r = np.nonzero(wanted & (part.label[:, None] != rows.label))
            score = integer_scores(part, rows, a, r)
            for k in range(widest):
                slot = begin[a + first] + k
                held = np.flatnonzero(slot < begin[a + first + 1])
                slot = slot[held]
                inside = (score[held] >= slots.low[slot]) & (score[held] <= slots.high[slot])
                best.add(slot[inside], score[held][inside], rows.vec_id[r[held]][inside])
    return {"key": best.key, "score": best.score, "vec_id": best.vec_id}


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, ints of the rows that take part: components become floor(scale * x)."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("ints"))


def build_index(rows: DataFrame, dim: int, tasks: int | None) -> DataFrame:
    """The rows with their codes, alignments and rests, written to the shared folder; shorter vectors end in zeros."""

    def make(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                given = part.column("ints")
                sizes = given.value_lengths().to_numpy(zero_copy_only=False)
                ints = np.zeros((part.num_rows, dim), np.int64)
                ints[np.arange(dim) < sizes[:, None]] = given.flatten().to_numpy(zero_copy_only=False)
                codes, alignments, rest = encode(ints)

                def listed(flat, width, kind):
                    ends = np.arange(0, len(flat) + 1, width, dtype=np.int32) if width else np.zeros(part.num_rows + 1, np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))

                yield {
                    "vec_id": part.column("vec_id"),
                    "label": part.column("label"),
                    "ints": listed(ints.reshape(-1).astype(np.int32), dim, pa.int32()),
                    "codes": listed(codes.reshape(-1).view(np.int64), LEVELS * codes.shape[2], pa.int64()),
                    "alignments": listed(alignments.reshape(-1), LEVELS, pa.float64()),
                    "rest": rest,
                }

    schema = "vec_id long, label long, ints array<int>, codes array<long>, alignments array<double>, rest double"
    return write_stage(map_tasks(rows.repartition(tasks) if tasks else rows, make, schema), "vector-codes")


def _best_per_key(found: DataFrame, most: int) -> DataFrame:
    """key, score, vec_id, rank: every task has sent at most `most` rows a key."""
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """The hardest permitted negatives of every anchor and positive.

    Needs vec_id, embedding and label, ignores other columns. Components become floor(scale * x); a score is the integer
    inner product with the anchor, higher first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible
    by `anchor_every`, positives an anchor's best other rows of its label, negatives its best rows of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score (none for a negative positive_score).
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with null vec_id, label or embedding or with any null or non-finite component take no part. Shorter vectors
    count as filled with zeros; empty ones score 0 everywhere. A row is never its own partner, nor is another row of
    its vec_id. Rows with a vec_id of other rows count each; anchors that are equal in all three columns count once. An
    empty table, or one without anchors, gives an empty table. Scores beyond 62 bits raise ValueError.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale)
    is_anchor = F.col("vec_id") % anchor_every == 0
    largest = F.max(F.array_max(F.transform("ints", lambda x: F.abs(x.cast("double")))))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("ints")).alias("dim"), largest.alias("largest")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not counts["anchors"]:
        return spark.createDataFrame([], result)
    dim, top = counts["dim"], counts["largest"] or 0.0
    if top >= 1 << 31 or top * top * max(dim, 1) >= 1 << 62:
        raise ValueError(f"components up to {top} in {dim} dimensions: scores pass 62 bits")
    parallel = spark.sparkContext.defaultParallelism
    # tables that scan into few tasks are dealt out; larger ones keep the tasks of their scan
    index = build_index(rows, dim, 2 * parallel if counts["n"] < parallel * 200_000 else None)
    blocks = -(-counts["anchors"] // block)
    path = new_stage_path(spark, "anchors")
    number = F.pmod(F.xxhash64("vec_id", "label", "ints"), F.lit(blocks)).alias("block")
    index.where(is_anchor).select("vec_id", "label", "ints").distinct().select("*", number).write.partitionBy("block").parquet(path)
    stored = spark.read.schema("vec_id long, label long, ints array<int>, block long").parquet(path)
    found = []
    for k in range(blocks):
        mined = _mine_block(index, stored.where(F.col("block") == k), dim, positives, negatives, least, most)
        if mined is not None:
            found.append(new_stage_path(spark, "hard-negatives"))
            mined.write.parquet(found[-1])
    return spark.read.schema(result).parquet(*found)


def _mine_block(index: DataFrame, block: DataFrame, dim: int, positives: int, negatives: int, least: int, most: int) -> DataFrame | None:
    spark = index.sparkSession
    table = block.orderBy("vec_id", "label", "ints").toArrow()
    if not table.num_rows:
        return None
    ints = table["ints"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)
    anchors = Anchors(table["vec_id"].to_numpy(), table["label"].to_numpy(), ints)
    schema = "key long, score long, vec_id long"
    near = map_tasks(index, lambda batches: iter([positives_of(anchors, batches, dim, positives)]), schema)
    chosen = _best_per_key(near, positives).orderBy("key", "rank").toArrow()  # at most `positives` rows an anchor
    key, score = chosen["key"].to_numpy(), chosen["score"].to_numpy()
    slots = Slots(key, -((-least * score) // 100), most * score // 100)
    far = map_tasks(index, lambda batches: iter([negatives_of(anchors, slots, batches, dim, negatives)]), schema)
    columns = {"key": np.arange(len(key)), "anchor_id": anchors.vec_id[key], "positive_id": chosen["vec_id"].to_numpy(), "positive_score": score}
    pairs = spark.createDataFrame(pa.table(columns), "key long, anchor_id long, positive_id long, positive_score long")
    ranked = _best_per_key(far, negatives).join(F.broadcast(pairs), "key")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
