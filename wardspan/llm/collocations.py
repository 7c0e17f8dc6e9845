"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases of most_words - 1 words; an edge is a phrase of most_words words, from the node of its first words to
that of its last, weighted by its occurrences. Only edges are counted from the texts, together with the shorter phrases
that end a piece. Every other count follows from the graph: a node occurs as often as its outgoing edges flow, plus the
pieces that end with it, and so on down to single words.

The edges are shuffled once, by their first word, so that all counts follow inside a task. Beginnings that a sample finds
frequent are dealt by more words; their own counts are summed over the tasks afterwards. The sample only balances the
tasks, counts do not depend on it.

Edges that meet in a node with one way in and one way out are compacted into paths: fixed passages, numbered from
their first edge by doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.llm.line_dedup import UPPER
from wardspan.llm.tables import map_batches
from wardspan.llm.words import LOWER_CODES, STEP, batches_of, find_spans, hash_spans, mix, text_bytes
from wardspan.session import write_stage

#: Bytes of text whose phrases are counted at once.
BLOCK = 1 << 20
#: A part in more than this share of all parts is joined by broadcast: at most 1 / HOT_SHARE parts can be that frequent.
HOT_SHARE = 1e-3
#: A beginning with more than 1 / (SPLIT * shuffle partitions) of the sampled windows is dealt by one word more.
SPLIT = 8
SAMPLE_DOCS = 4_000
#: Classes of the phrases of a language that are ranked before the language is.
SALTS = 64

PIECE_BREAK = np.zeros(256, bool)
PIECE_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BREAK = PIECE_BREAK.copy()
WORD_BREAK[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in UPPER.lower()]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of `data` as strings; ranges may overlap."""
    sizes = ends - starts
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(total), pa.py_buffer(data[at]))


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with texts beyond BLOCK cut at the ends of pieces, and the text of each segment."""
    owner = np.arange(len(offsets) - 1)
    cuts = []
    for k in np.flatnonzero(np.diff(offsets) > BLOCK):
        stops = np.flatnonzero(PIECE_BREAK[data[offsets[k] : offsets[k + 1]]]) + 1 + offsets[k]
        wanted = np.searchsorted(stops, np.arange(offsets[k] + BLOCK, offsets[k + 1], BLOCK))
        cuts.append(stops[np.unique(wanted[wanted < len(stops)])])
    if not cuts:
        return offsets, owner
    cuts = np.concatenate(cuts)
    inner = cuts[~np.isin(cuts, offsets)]
    owners = np.searchsorted(offsets, inner, "right") - 1
    at = np.concatenate([offsets[:-1], inner])
    order = np.argsort(at, kind="stable")
    return np.concatenate([at[order], offsets[-1:]]), np.concatenate([owner, owners])[order]


def _blocks(offsets: np.ndarray):
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, j
        i = j


def _count_block(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, most_words: int, hot: list[pa.Array]):
    """Text, phrase, count, depth and bucket of the distinct windows of a block: each word opens one, as long as its piece allows.

    The bucket depends on the first `depth` words: one, and one more for every beginning that is `hot`.
    """
    starts, ends, bounds = find_spans(data, offsets, WORD_BREAK)
    n = len(starts)
    if not n:
        return None
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    broken = np.cumsum(PIECE_BREAK[data])[starts]
    opens = np.ones(n, bool)
    opens[1:] = (text[1:] != text[:-1]) | (broken[1:] != broken[:-1])
    first = np.flatnonzero(opens)
    stop = np.append(first[1:], n)[np.cumsum(opens) - 1]
    size = np.minimum(most_words, stop - np.arange(n))
    lower = LOWER[data]
    word = _strings(lower, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_words = int(word.max()) + 2
    key = group[text] * n_words + word
    for k in range(1, most_words):
        later = np.zeros(n, np.int64)
        if n > k:
            later[:-k] = np.where(size[:-k] > k, word[k:] + 1, 0)
        key = np.unique(key, return_inverse=True)[1] * n_words + later
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    # words one after another, each followed by one blank: every window is a range of bytes
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(begin[-1] + lengths[-1], 0x20, np.uint8)
    joined[np.arange(lengths.sum()) + np.repeat(np.arange(n), lengths)] = lower[~WORD_BREAK[data]]
    last = at + size[at] - 1
    with np.errstate(over="ignore"):
        hashes = hash_spans(data, starts, ends, LOWER_CODES)
        depth, bucket, open_ = np.ones(len(at), np.int32), hashes[at], np.arange(len(at))
        for words, frequent in enumerate(hot, 1):
            open_ = open_[size[at[open_]] >= words]
            end = at[open_] + words - 1
            open_ = open_[pc.is_in(_strings(joined, begin[at[open_]], begin[end] + lengths[end]), frequent).to_numpy(zero_copy_only=False)]
            depth[open_] = words + 1
            longer = open_[size[at[open_]] > words]
            bucket[longer] = mix(bucket[longer] * STEP + hashes[at[longer] + words])
    return text[at], _strings(joined, begin[at], begin[last] + lengths[last]), count, depth, (bucket >> np.uint64(40)).astype(np.int64)


def windows_of(docs: DataFrame, most_words: int, hot: list[list[str]]) -> DataFrame:
    """lang, phrase, n, depth, bucket: phrases of `most_words` words and the shorter ones that end a piece, counted per block of text."""
    frequent = [pa.array(phrases, pa.large_string()) for phrases in hot]

    def make(batch: pa.RecordBatch):
        texts = batch.column("text")
        for i, j in batches_of(texts, BLOCK):
            langs = batch.column("lang").slice(i, j - i).dictionary_encode()
            data, offsets = text_bytes(texts.slice(i, j - i))
            offsets, owner = _segments(data, offsets)
            lang = langs.indices.to_numpy().astype(np.int64)[owner]
            for a, b in _blocks(offsets):
                part = offsets[a : b + 1]
                counted = _count_block(data[part[0] : part[-1]], part - part[0], lang[a:b], most_words, frequent)
                if counted:
                    text, phrases, n, depth, bucket = counted
                    yield {"lang": langs.dictionary.take(pa.array(lang[a:b][text])), "phrase": phrases, "n": n, "depth": depth, "bucket": bucket}

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return map_batches(rows, make, "lang string, phrase string, n long, depth int, bucket int")


def frequent_beginnings(docs: DataFrame, most_words: int) -> list[list[str]]:
    """Per number of words, the beginnings that would fill a task, from a sample of about SAMPLE_DOCS documents; at most SPLIT a task."""
    total = docs.count()
    if not total or most_words < 2:
        return []
    sampled = docs.sample(min(1.0, SAMPLE_DOCS / total), 11)
    windows = windows_of(sampled, most_words, [])
    starts = F.array_distinct(F.array(*[first_words("phrase", words) for words in range(1, most_words)]))
    held = windows.select("n", F.explode(starts).alias("start")).groupBy("start").agg(F.sum("n").alias("n"))
    least = 1 / (SPLIT * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # single words open every window once
    every = F.sum(F.when(F.instr("start", " ") == 0, F.col("n"))).over(Window.partitionBy())
    found = held.withColumn("every", every).where(F.col("n") > F.col("every") * least).select("start").collect()
    hot = [[] for _ in range(most_words - 1)]
    for row in found:
        hot[row["start"].count(" ")].append(row["start"])
    return hot


def first_words(phrase: str, words: int) -> Column:
    return F.substring_index(F.col(phrase), " ", words)


def last_words(phrase: str, words: int) -> Column:
    return F.substring_index(F.col(phrase), " ", -words)


def phrase_counts(docs: DataFrame, most_words: int, least: int) -> DataFrame:
    """lang, phrase, words, a of all phrases up to `most_words` words that occur `least` times or more, and of all words.

    Shorter counts are node flow plus piece ends: the longer phrases that begin with a phrase, and its occurrences at
    the end of a piece. The counts go down from length to length inside the tasks; what is too rare only flows on.
    Counts of beginnings that are dealt by more words than they have come in parts and are summed at the end.
    """
    windows = windows_of(docs, most_words, frequent_beginnings(docs, most_words)).repartition("bucket")
    keys = ["bucket", "depth", "lang", "phrase"]
    rows = windows.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("kind", F.lit("flow"))
    for words in range(most_words - 1, 0, -1):
        start = first_words("phrase", words)
        down = F.struct(F.lit("flow").alias("kind"), start.alias("phrase"), "n")
        # a phrase of `words` words or less is its own start: it ended a piece
        node = (F.col("kind") == "flow") & (start != F.col("phrase"))
        whole = F.col("depth") <= words + 1
        stay = F.struct(F.when(F.col("kind") != "flow", F.col("kind")).when(whole, F.lit("settled")).otherwise(F.lit("part")).alias("kind"), F.col("phrase"), "n")
        kept = F.when(F.col("kind") != "flow", F.array(stay)).when(node & (~whole | (F.col("n") >= least)), F.array(down, stay)).otherwise(F.array(down))
        rows = rows.select("bucket", "depth", "lang", F.inline(kept)).groupBy(*keys, "kind").agg(F.sum("n").alias("n"))
    part = (F.col("kind") == "part") | ((F.col("kind") == "flow") & (F.col("depth") > 1))
    found = write_stage(rows.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), part.alias("part"), F.col("n").alias("a")), "phrase-parts")
    summed = found.where("part").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    return write_stage(found.where("NOT part").select(*summed.columns).unionAll(summed).where((F.col("a") >= least) | (F.col("words") == 1)), "phrase-counts")


def with_parts(candidates: DataFrame, counts: DataFrame, most_words: int) -> DataFrame:
    """`candidates` (lang, phrase, words, a) with l_k and r_k, the counts of the first k words and of the rest.

    All parts of all candidates are looked up in one join; parts that very many candidates share go by broadcast.
    """
    cuts = [(words, k) for words in range(2, most_words + 1) for k in range(1, words)]
    sides = [
        F.when(F.col("words") == words, F.struct(cut.alias("part"), F.lit(f"{side}_{k}").alias("place")))
        for words, k in cuts
        for side, cut in (("l", first_words("phrase", k)), ("r", last_words("phrase", words - k)))
    ]
    parts = write_stage(candidates.select("*", F.inline(F.array_compact(F.array(*sides)))), "phrase-parts")
    total = parts.count()
    hot = parts.groupBy("lang", "part").count().where(F.col("count") > HOT_SHARE * total)
    named = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("held"))
    often = hot.join(named, ["lang", "part"]).select("lang", "part", F.col("held").alias("often"))
    marked = parts.join(F.broadcast(often), ["lang", "part"], "left")
    spread = F.when(F.col("often").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("phrase", "place"))
    known = named.withColumn("spread", F.lit(0).cast("long"))
    joined = marked.withColumn("spread", spread).join(known, ["lang", "part", "spread"], "left")
    value = F.coalesce("often", "held")
    wide = [F.max(F.when(F.col("place") == f"{side}_{k}", value)).alias(f"{side}_{k}") for k in range(1, most_words) for side in "lr"]
    return joined.groupBy("lang", "phrase", "words", "a").agg(*wide)


def score_of(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact in decimals of 38 digits (a below 10 ** 16)."""
    a, left, right = (f"CAST({c} AS DECIMAL(19, 0))" for c in (a, left, right))
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a}) DIV ({left} * {right}) AS BIGINT)")


def scored(wide: DataFrame, most_words: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score at the cut that scores lowest, the earliest of several."""
    cuts = [
        F.when(F.col("words") > k, F.struct(score_of("a", f"l_{k}", f"r_{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l_{k}").alias("l"), F.col(f"r_{k}").alias("r")))
        for k in range(1, most_words)
    ]
    lowest = F.array_min(F.array_compact(F.array(*cuts)))
    return wide.select("lang", "phrase", "words", "a", lowest.alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of the candidates inside a longer one with 100 * f(longer) >= percent * a.

    One word more is enough to look at: whatever is longer still lies around such a phrase and is no more frequent.
    """
    ends = F.expr("array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words))")
    inner = candidates.where("words > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("around"))
    heaviest = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return candidates.join(heaviest, ["lang", "phrase"]).where(F.col("around") * 100 >= F.col("a") * percent).select("lang", "phrase")


def compact_paths(edges: DataFrame, most_words: int) -> DataFrame:
    """lang, phrase, path, path_at: the unary path of each edge (lang, phrase), named by its first edge, and its place there (from 0).

    A node is unary if exactly one edge enters and one leaves it. Edges of a cycle of unary nodes have no first edge and
    stay single. Every round looks twice as far back; the edges still on their way point at different edges, so no key is hot.
    """
    into = edges.groupBy("lang", last_words("phrase", most_words - 1).alias("node")).agg(F.count("*").alias("ways_in"), F.max("phrase").alias("before"))
    out = edges.groupBy("lang", first_words("phrase", most_words - 1).alias("node")).agg(F.count("*").alias("ways_out"), F.max("phrase").alias("phrase"))
    links = into.join(out, ["lang", "node"]).where("ways_in = 1 AND ways_out = 1").select("lang", "phrase", "before")
    done = F.col("before").isNull()
    at = write_stage(
        edges.join(links, ["lang", "phrase"], "left").select("lang", "phrase", F.coalesce("before", "phrase").alias("path"), F.when(done, 0).otherwise(1).cast("long").alias("path_at"), done.alias("done")),
        "paths",
    )
    left = None
    while left != 0:
        moving, arrived = at.where("NOT done"), at.where("done")
        further = at.select("lang", F.col("phrase").alias("path"), F.col("path").alias("above"), F.col("path_at").alias("more"), F.col("done").alias("there"))
        step = moving.join(further, ["lang", "path"]).select("lang", "phrase", F.col("above").alias("path"), (F.col("path_at") + F.col("more")).alias("path_at"), F.col("there").alias("done"))
        at = write_stage(step.unionAll(arrived), "paths")
        before, left = left, at.where("NOT done").count()
        if left == before:  # nobody reached a first edge: only cycles are left
            break
    single = F.when(F.col("done"), F.col("path")).otherwise(F.col("phrase"))
    return at.select("lang", "phrase", single.alias("path"), F.when(F.col("done"), F.col("path_at")).otherwise(0).alias("path_at"))


def best_of_language(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each lang with their rank; classes of phrases are cut first, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    classes = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(classes)).where(F.col("rank") <= most).drop("rank")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", place).where(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, most_words: int = 3, least: int = 10, percent: int = 50, most: int = 2000) -> DataFrame:
    """The best collocations of every language.

    Needs text and lang, ignores other columns. Texts are lower-cased (A-Z) and split at `[.,;:!?\\x0A-\\x0D]` into
    pieces and those at blanks and tabs into words; phrases lie within a piece, and all occurrences count, overlapping
    ones too. Candidates have 2 to `most_words` words and a >= `least`. Cut after its first k words a candidate scores
    floor(1000000 * a * a / (l * r)); its lowest cut counts, the earliest of several. Candidates inside any longer
    candidate with 100 * f(longer) >= percent * a are dropped. Returns each language's first `most` by falling score,
    falling a and phrase (by bytes): lang, rank, phrase, a, l, r, n (words of the language), score, and for phrases of
    `most_words` words path and path_at (`compact_paths` over the candidates of that length).

    Null text is empty; null lang is `und`, together with texts so marked. Repeated rows count each. A language without
    candidates has no rows; an empty table gives an empty table.
    """
    counts = phrase_counts(docs, most_words, least)
    candidates = counts.where((F.col("words") > 1) & (F.col("a") >= least))
    # every part of a candidate is at least as frequent as the candidate
    known = counts.where((F.col("words") < most_words) & (F.col("a") >= least))
    kept = candidates.join(absorbed(candidates, percent), ["lang", "phrase"], "left_anti")
    best = best_of_language(scored(with_parts(kept, known, most_words), most_words), most)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    paths = compact_paths(candidates.where(F.col("words") == most_words).select("lang", "phrase"), most_words)
    named = write_stage(best, "phrases").join(totals, "lang").join(paths, ["lang", "phrase"], "left")
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path", "path_at")
