"""Near duplicates by MinHash with tensored banding, every link confirmed on full shingle sets.

A small collection of BANDS sub-hashes (each joins ROWS minhashes) gives the keys of all BANDS * (BANDS - 1) / 2 tables:
a table key is a pair of sub-hashes, so the tables cost BANDS * ROWS minhashes instead of BANDS ** 2 * ROWS. Two texts
are candidates if at least two sub-hashes agree; at a similarity of exactly 0.75 that fails for 4 pairs in 10,000, at
0.8 for 2 in 100,000.

Steps, none of which lists the pairs of a group:
1. Documents with equal shingle sets form a class; its smallest doc_id stands for it.
2. Some tables link every representative to the smallest one that shares a bucket with it (one link each at most),
   which contracts groups of near copies.
3. Sub-hashes met in one component only are dropped. The rest form all table keys; representatives that share one with a
   representative of another component stay open. Open representatives of different components are verified if they
   share one of their rarest shingles, as every linked pair must, if their sizes allow the similarity and if their
   sketches are near enough.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import components, map_batches
from wardspan.llm.words import STEP, batches_of, mix, window_hashes, word_hashes
from wardspan.session import write_stage

WIDTH = 5
PERCENT = 75
BANDS = 28
ROWS = 4
HASHES = BANDS * ROWS
#: One-bit minhashes of a sketch. Of these 1,792 agree at a similarity of 0.75 (deviation 15); four deviations less pass.
SKETCH = 2048
SKETCH_LEAST = 1732
PIECE = 4096

_random = np.random.default_rng(5)
FACTORS = _random.integers(1, 1 << 63, HASHES + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, HASHES + SKETCH, dtype=np.uint64)


def shingle_sets(column, width: int = WIDTH):
    """Sorted distinct shingle hashes of each text. Fewer words than `width` are one shingle, no words none."""
    words, bounds = word_hashes(column, lower=True)
    windows = window_hashes(words, width)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= width:
            yield np.unique(windows[first : last - width + 1])
        elif last > first:
            short = np.uint64(last - first)
            for word in words[first:last]:
                short = mix(np.array([short * STEP + word]))[0]
            yield np.array([short])
        else:
            yield np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray, which: slice) -> np.ndarray:
    factors, shifts = FACTORS[which], SHIFTS[which]
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    piece = max(1, PIECE * HASHES // len(factors))
    for k in range(0, len(shingles), piece):
        spread = np.multiply.outer(shingles[k : k + piece], factors)
        spread += shifts
        np.minimum(least, spread.min(axis=0), out=least)
    return least


def one_bit_sketch(shingles: np.ndarray) -> np.ndarray:
    bits = (mix(minhashes(shingles, slice(HASHES, None))) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def _signatures(batch: pa.RecordBatch):
    texts = batch.column("text")
    for i, j in batches_of(texts):
        sizes, lows, highs, bands = [], [], [], []
        with np.errstate(over="ignore"):
            for shingles in shingle_sets(texts.slice(i, j - i)):
                sizes.append(len(shingles))
                lows.append(mix(shingles).sum(dtype=np.uint64))
                highs.append(mix(shingles ^ STEP).sum(dtype=np.uint64))
                rows = minhashes(shingles, slice(HASHES)).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * STEP + rows[:, r])
                bands.append(key)
        yield {
            "doc_id": batch.column("doc_id").slice(i, j - i),
            "n_shingles": np.array(sizes, np.int64),
            "set_low": np.array(lows, np.uint64).view(np.int64),
            "set_high": np.array(highs, np.uint64).view(np.int64),
            "bands": lists(np.array(bands, np.uint64)),
        }


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def _sets(batch: pa.RecordBatch):
    texts = batch.column("text")
    for i, j in batches_of(texts):
        sets = list(shingle_sets(texts.slice(i, j - i)))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64)
        yield {"node": batch.column("doc_id").slice(i, j - i), "shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}


def _sketches(batch: pa.RecordBatch):
    with np.errstate(over="ignore"):
        sets = batch.column("shingles")
        flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))
        found = [one_bit_sketch(part) for part in np.split(flat, ends[:-1])] if len(sets) else []
    if found:
        yield {"node": batch.column("node"), "sketch": lists(np.array(found, np.uint64))}


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the documents whose doc_id is among `nodes` (column node)."""
    texts = docs.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return write_stage(map_batches(texts, _sets, "node long, shingles array<long>"), "shingles")


def verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) whose full shingle sets reach the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    whole = F.size("a_set") + F.size("b_set") - both
    return links.join(one, "a").join(two, "b").where((both * 100 >= whole * PERCENT) & (whole > 0)).select("a", "b")


def rarest(sets: DataFrame) -> DataFrame:
    """node, place, shingle: the rarest shingles of each set, as many as any linked pair must share one of.

    Two sets that reach the similarity share one of the n - ceil(0.75 n) + 1 shingles that come first in any common order;
    here the rarest among `sets` come first. Shingles of one set only can't be shared, but take their places.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    shared = each.join(counts, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    places = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - alone
    first = shared.withColumn("places", places.cast("int")).where("places > 0")
    taken = first.select("node", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.col("places"))["shingle"]).alias("place", "shingle"))
    return taken.select("node", (F.col("alone") + F.col("place") + 1).alias("place"), "shingle")


def agreeing(one: str, two: str) -> Column:
    """How many one-bit minhashes of two sketches agree."""
    apart = [F.bit_count(F.get(F.col(one), F.lit(k)).bitwiseXOR(F.get(F.col(two), F.lit(k)))) for k in range(SKETCH // 64)]
    return F.lit(SKETCH) - sum(apart[1:], apart[0])


def _table_keys(bands: str) -> Column:
    """Keys of all pairs of the sub-hashes (struct at, key) of one row."""
    pair = lambda x, y: F.xxhash64(x["at"], y["at"], x["key"], y["key"])
    later = lambda x: F.filter(bands, lambda y: y["at"] > x["at"])
    return F.flatten(F.transform(bands, lambda x: F.transform(later(x), lambda y: pair(x, y))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate components: doc_id, n_shingles, component_id, kept, one row per row of `docs`.

    Needs doc_id and text, ignores other columns. Words are runs of bytes other than `[\\x20\\x09-\\x0D]`, A-Z
    lower-cased; a text's set is its distinct 5-word shingles, or all its words as one shingle if it has fewer. Texts
    are linked if 100 * intersection >= 75 * union; component_id is the smallest doc_id reachable, and the document of
    that id is kept. Null, empty and blank texts have no shingles and stay alone. Each of several rows with one doc_id
    gets the component of its own text. Rows without doc_id are linked with nothing: component_id null, kept. An empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_low long, set_high long, bands array<long>"
    signed = write_stage(map_batches(docs, _signatures, schema), "signatures")
    same = ["set_low", "set_high"]
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    members = write_stage(signed.select("doc_id", "n_shingles", *same).join(classes, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")), "members")
    reps = write_stage(
        linkable.join(classes.select(*same, "rep"), same).where("doc_id = rep").dropDuplicates(["rep", *same]).select("rep", "n_shingles", "bands"), "reps"
    )

    tables = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 2), F.lit(2)), lambda i: F.xxhash64(i, F.get("bands", i), F.get("bands", i + 1)))
    buckets = reps.select("rep", F.explode(tables).alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    stars = buckets.join(shared, "key").where("first < rep").groupBy(F.col("rep").alias("b")).agg(F.min("first").alias("a"))
    stars = write_stage(stars.select("a", "b"), "stars")
    near = components(verified(stars, sets_of(docs, stars.select(F.explode(F.array("a", "b")).alias("node")))))

    grouped = write_stage(reps.join(near, reps["rep"] == near["node"], "left").withColumn("part", F.coalesce("root", "rep")).drop("node", "root"), "grouped")
    exploded = grouped.select("rep", "part", F.posexplode("bands").alias("at", "key"))
    across = exploded.groupBy("at", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("at", "key")
    left = exploded.join(across, ["at", "key"]).groupBy("rep", "part").agg(F.array_sort(F.collect_set(F.struct("at", "key"))).alias("keys"))
    keyed = left.where(F.size("keys") > 1).select("rep", "part", F.explode(_table_keys("keys")).alias("key"))
    keyed = write_stage(keyed, "table-keys")
    open_keys = keyed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    nodes = write_stage(keyed.join(open_keys, "key", "left_semi").select(F.col("rep").alias("node")).distinct(), "open-nodes")
    sets = sets_of(docs, nodes)
    parts = grouped.select(F.col("rep").alias("node"), "part")
    first = write_stage(rarest(sets).join(parts, "node"), "rarest")
    across = first.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
    first = write_stage(first.join(across, "shingle", "left_semi"), "shared-rarest")
    sketched = map_batches(sets.join(first.select("node").distinct(), "node", "left_semi"), _sketches, "node long, sketch array<long>")
    sizes = grouped.select(F.col("rep").alias("node"), "n_shingles")
    held = first.join(write_stage(sketched.join(sizes, "node"), "sketches"), "node")
    one, two = (held.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "place", "part", "n_shingles", "sketch")]) for s in "ab")
    # at its first common shingle, a linked pair still has room for the intersection it needs
    needed = F.ceil((F.col("n_shingles_a") + F.col("n_shingles_b")) * PERCENT / (100 + PERCENT))
    room = 1 + F.least(F.col("n_shingles_a") - F.col("place_a"), F.col("n_shingles_b") - F.col("place_b"))
    fits = (room >= needed) & (agreeing("sketch_a", "sketch_b") >= SKETCH_LEAST)
    pairs = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("part_a") < F.col("part_b")) & fits)
    pairs = write_stage(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "pairs")
    sure = verified(pairs, sets)

    part_of = grouped.select("rep", "part")
    bridges = sure.join(part_of.select(F.col("rep").alias("a"), F.col("part").alias("a_part")), "a").join(part_of.select(F.col("rep").alias("b"), F.col("part").alias("b_part")), "b")
    joined = components(bridges.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")))
    roots = grouped.join(joined, grouped["part"] == joined["node"], "left").groupBy("rep").agg(F.min(F.coalesce("root", "part")).alias("component_id"))
    out = members.join(roots, "rep", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
