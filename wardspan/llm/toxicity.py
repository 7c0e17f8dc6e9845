"""Toxicity by weak supervision.

Many voters (lexicons, patterns, and word lists learned from labelled rows) vote toxic, clean or nothing on every document.
A generative label model estimates from the votes of all documents how accurate each voter is and which voters repeat one
another; its posteriors are the labels of a linear classifier over word features, trained on a bounded sample, which
scores every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import distinct_texts, map_batches, picked
from wardspan.llm.words import LOWER_CODES, batches_of, find_spans, hash_spans, text_bytes
from wardspan.session import write_stage

#: Fixed word lists; words of several languages, lower case.
LEXICONS = {
    "insults": "idiot moron loser clown fool imbecile dumbass jerk idiota imbecil tonto payaso idiote crétin abruti bouffon dummkopf trottel versager vollidiot",
    "contempt": "pathetic worthless disgusting stupid useless ridiculous hopeless patético inútil asqueroso estúpido pathétique dégoûtant stupide erbärmlich wertlos ekelhaft dumm",
    "degrading": "trash scum garbage vermin filth parasite basura escoria ordure racaille abschaum müll",
    "hostile": "hate despise kill destroy shut odio matar déteste tuer hasse vernichten",
    "obscene": "damn hell crap bastard bitch ass shit fuck mierda puta merde putain scheisse arschloch",
}
PATTERNS = {
    "directed": r"(?i)\b(you|your|they|he|she|these|those)\b[^.!?\n]{0,40}\b(idiots?|morons?|losers?|clowns?|scum|trash|pathetic|worthless|stupid|disgusting)\b",
    "paired": r"(?i)\b(idiot|moron|loser|clown|scum|trash|pathetic|worthless|stupid|disgusting)\b\W+(\w+\W+){0,3}\b(idiot|moron|loser|clown|scum|trash|pathetic|worthless|stupid|disgusting)\b",
}
#: Every match of a pattern holds one of these, with the letters that Python takes for i, s and k when case is ignored.
MARKS = "(?i)" + re.sub("[isk]", lambda m: {"i": "[iİı]", "s": "[sſ]", "k": "[k\u212a]"}[m[0]], "idiot|moron|loser|clown|scum|trash|pathetic|worthless|stupid|disgusting")
#: A labelled sample of this many rows gives the learned list; a sample of this many documents trains the classifier.
LABELLED_ROWS = 20_000
TRAIN_DOCS = 10_000
#: Learned lists: whole words (0) and stems of so many bytes, the most frequent LEARNED_WORDS with these log odds.
LEARNED = (0, 4, 5)
LEARNED_WORDS, LEAST_ODDS, LEAST_DOCS = 60, 4.5, 5
THRESHOLD = 0.7
#: Prior of the share of clean documents with a toxic vote of one voter, and how many clean documents it counts as.
FALSE_SHARE, FALSE_DOCS = 0.003, 1_000
HASH_BITS = 12

BREAKS = np.ones(256, bool)
BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False


def letter_words(texts: pa.Array, stems: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the runs of letters of all texts (A-Z lower-cased), once per entry of `stems`, and each text's first.

    A stem of k bytes stands for all words that begin with it; shorter words hash to 0, 0 stands for whole words.
    """
    data, offsets = text_bytes(texts)
    starts, ends, bounds = find_spans(data, offsets, BREAKS)
    out = []
    with np.errstate(over="ignore"):
        for k in stems:
            if not k:
                out.append(hash_spans(data, starts, ends, LOWER_CODES))
                continue
            whole = ends - starts >= k
            found = np.zeros(len(starts), np.uint64)
            found[whole] = hash_spans(data, starts[whole], starts[whole] + k, LOWER_CODES)
            out.append(found)
    return out, bounds


def hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(letter_words(pa.array(words or [""]))[0][0])


@dataclass
class Voters:
    """Word lists as sorted hashes with the length of their stems (0: whole words), and compiled patterns that are tried
    on texts with one of MARKS."""

    lists: list[tuple[int, np.ndarray]]
    patterns: list[re.Pattern]

    def __len__(self) -> int:
        return len(self.lists) + len(self.patterns) + 1

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Hits of each list and pattern per text (texts x voters - 1), words per text, and the words themselves."""
        stems = tuple(sorted({stem for stem, _ in self.lists} | {0}))
        keys, bounds = letter_words(texts, stems)
        words_of = dict(zip(stems, keys, strict=True))
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        hits = np.zeros((len(texts), len(self) - 1))
        for k, (stem, known) in enumerate(self.lists):
            if len(known):
                words = words_of[stem]
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hits[:, k] = np.bincount(owner[known[at] == words], minlength=len(texts))
        marked = pc.fill_null(pc.match_substring_regex(texts, MARKS), False)
        for row in np.flatnonzero(np.asarray(marked)):
            text = texts[int(row)].as_py()
            for k, pattern in enumerate(self.patterns, len(self.lists)):
                hits[row, k] = sum(1 for _ in pattern.finditer(text))
        return hits, np.diff(bounds), (words_of[0], owner)

    def votes(self, hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """1 toxic, 0 clean, -1 nothing. Lists and patterns vote toxic on a hit; the last voter looks at the density of all
        list hits and alone votes clean, where nothing hits."""
        out = np.full((len(hits), len(self)), -1, np.int8)
        out[:, :-1][hits > 0] = 1
        listed = hits[:, : len(self.lists)].sum(axis=1)
        out[:, -1] = np.where(listed * 200 >= np.maximum(n_words, 1), 1, np.where(hits.any(axis=1), -1, 0))
        return out


def usable_labels(labels: DataFrame, rows: int) -> dict[int, int]:
    """toxic by doc_id of at most `rows` labelled rows that may be learned from, in the order of a hash."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) <> 1")
    taken = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return {row["doc_id"]: row["toxic"] for row in taken.collect()}


def learned_lists(docs: DataFrame, known, words: int) -> list[tuple[int, np.ndarray]]:
    """The words and stems whose smoothed log odds of a toxic label are high, among the labelled rows (broadcast)."""

    def count(batch):
        ids = batch.column("doc_id").to_pylist()
        marked = [k for k, i in enumerate(ids) if i in known.value]
        if not marked:
            return
        toxic = np.array([known.value[ids[k]] for k in marked])
        keys, bounds = letter_words(batch.column("text").take(pa.array(marked)), LEARNED)
        owners = np.repeat(np.arange(len(marked)), np.diff(bounds))
        for stem, found in zip(LEARNED, keys, strict=True):
            order = np.lexsort((owners, found))
            word, owner = found[order], owners[order]
            fresh = word != 0
            fresh[1:] &= (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            each, at = np.unique(word[fresh], return_inverse=True)
            bad = np.bincount(at, weights=toxic[owner[fresh]], minlength=len(each))
            yield {"stem": np.full(len(each), stem), "word": each.view(np.int64), "bad": bad.astype(np.int64), "n": np.bincount(at, minlength=len(each))}

    counted = map_batches(docs, count, "stem int, word long, bad long, n long")
    sums = counted.groupBy("stem", "word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    n_bad = sum(known.value.values())
    n_good = len(known.value) - n_bad
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_good + 1.0))
    best = write_stage(sums.where((F.col("bad") >= LEAST_DOCS) & (odds >= LEAST_ODDS)), "learned-words")
    lists = []
    for stem in LEARNED:
        top = best.where(F.col("stem") == stem).orderBy(F.desc("bad"), "word").limit(words).collect() if n_bad else []
        lists.append((stem, np.sort(np.array([row["word"] for row in top], np.int64).view(np.uint64))))
    return lists


@dataclass
class LabelModel:
    """prior of toxic, chance of each vote given the class (class x voter x vote), and a weight per voter."""

    prior: float
    table: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        voter = np.arange(votes.shape[1])
        score = np.log(self.prior / (1 - self.prior)) + ((np.log(self.table[1, voter, votes + 1]) - np.log(self.table[0, voter, votes + 1])) * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, labels: np.ndarray | None = None, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over the distinct vote rows and their counts.

    Rows with a label (1 toxic, 0 clean, -1 none) keep it, and the first table is counted from them. The share of false
    toxic votes of a voter is estimated like all others, from a Beta prior. After each fit the votes' correlations within the classes are estimated; a voter's evidence is divided by one plus the
    sum of its positive correlations with others, so that voters who repeat one another count about once.
    """
    n = votes.shape[1]
    table = np.empty((2, n, 3))
    table[1] = [0.55, 0.05, 0.4]
    table[0] = [0.55, 0.43, 0.02]
    model = LabelModel(0.1, table, np.ones(n))
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    labels = np.full(len(votes), -1) if labels is None else labels

    def shares_of(mass: np.ndarray, start: np.ndarray) -> np.ndarray:
        return (np.einsum("r,rvk->vk", mass, shown) + start) / (mass.sum() + start.sum(axis=-1, keepdims=True))

    for c in (0, 1):
        table[c] = shares_of((labels == c) * counts, 20 * table[c])
    for _ in range(rounds):
        p = np.where(labels < 0, model.posterior(votes), labels)
        for c, share in ((1, p), (0, 1 - p)):
            table[c] = shares_of(share * counts, np.full((n, 3), 0.5))
        clean = ((1 - p) * counts).sum()
        false = (clean * table[0, :, 2] + FALSE_DOCS * FALSE_SHARE) / (clean + FALSE_DOCS)
        table[0] *= ((1 - false) / np.maximum(1 - table[0, :, 2], 1e-9))[:, None]
        table[0, :, 2] = false
        model.prior = float(np.clip((p * counts).sum() / max(1, counts.sum()), 1e-3, 0.5))
        shared = np.zeros((n, n))
        for share in (p, 1 - p):
            mass = share * counts
            if mass.sum() > 1:
                centred = votes - (mass @ votes) / mass.sum()
                cov = (centred * mass[:, None]).T @ centred / mass.sum()
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                shared += mass.sum() / counts.sum() * np.clip(cov / np.outer(spread, spread), 0, 1)
        model.weight = 1 / (1 + shared.sum(axis=1) - np.diag(shared))
    return model


def features(hits: np.ndarray, n_words: np.ndarray, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Dense features of the hits, and the hashed words as (text, bucket, weight)."""
    listed = hits.sum(axis=1)
    size = np.sqrt(np.maximum(n_words, 1))
    dense = np.column_stack([np.ones(len(hits)), listed > 0, np.log1p(listed), np.minimum(1, 20 * listed / size**2), np.log1p(hits)])
    return dense, (owner, (words >> np.uint64(64 - HASH_BITS)).astype(np.int64), (1 / size)[owner])


def training_sample(docs: DataFrame, total: int, most: int) -> DataFrame:
    """text and n, the rows that have it: at most `most` distinct texts, picked and ordered by a hash; about `total` distinct
    texts in all."""
    order = F.xxhash64(F.lit(7), "text")
    sample = docs.where(picked(order, total, most))
    return sample.groupBy("text").agg(F.count("*").alias("n")).orderBy(order, "text").limit(most)


def fit_classifier(dense: np.ndarray, sparse: tuple, target: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on soft labels by Adam, each row as often as counted; hashed words are shrunk much more than the
    hits."""
    owner, bucket, weight = sparse
    params = [np.zeros(dense.shape[1]), np.zeros(1 << HASH_BITS)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for turn in range(1, rounds + 1):
        score = dense @ params[0] + np.bincount(owner, weights=weight * params[1][bucket], minlength=len(dense))
        gap = (1 / (1 + np.exp(-score)) - target) * counts / max(1, counts.sum())
        slopes = [dense.T @ gap + 1e-5 * params[0], np.bincount(bucket, weights=weight * gap[owner], minlength=1 << HASH_BITS) + 1e-2 * params[1]]
        for p, g, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return params[0], params[1]


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on) of every row.

    `docs` needs doc_id and text, `labels` doc_id and toxic; other columns are ignored. Labels are learned from only in
    rows whose crc32(doc_id as text) mod 3 is not 1, for the learned lists and the label model (at most `labelled_rows` rows); no
    score depends on a document's own label, id, language or source. Votes are counted over all documents, the
    classifier is trained on at most `train_docs` distinct texts in the order of a hash, weighted by their rows. Null and empty texts have no
    words and a low score; a null doc_id is held out never. Without labels the fixed lists vote alone. Repeated rows
    are scored each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = spark.sparkContext.broadcast(usable_labels(labels, labelled_rows))
    lists = [(0, hashes_of(words.split())) for words in LEXICONS.values()] + learned_lists(docs, known, LEARNED_WORDS)
    voters = spark.sparkContext.broadcast(Voters(lists, [re.compile(p) for p in PATTERNS.values()]))

    def vote(batch):
        for i, j in batches_of(batch.column("text")):
            hits, n_words, _ = voters.value.counts(batch.column("text").slice(i, j - i))
            marks = np.array([known.value.get(d, -1) for d in batch.column("doc_id").slice(i, j - i).to_pylist()], np.int8)
            rows, counts = np.unique(np.column_stack([voters.value.votes(hits, n_words), marks]), axis=0, return_counts=True)
            yield {"votes": [r.tolist() for r in rows], "n": counts}

    seen = map_batches(docs, vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    rows = np.array([row["votes"] for row in seen], np.int64).reshape(len(seen), len(voters.value) + 1)
    model = fit_label_model(rows[:, :-1], np.array([row["n"] for row in seen], float), rows[:, -1])
    sample = training_sample(docs.select("text"), distinct_texts(docs, F.xxhash64(F.lit(7), "text")), train_docs)

    def describe(batch):
        texts = batch.column("text")
        for i, j in batches_of(texts):
            hits, n_words, (words, owner) = voters.value.counts(texts.slice(i, j - i))
            dense, (_, bucket, _) = features(hits, n_words, words, owner)
            target = model.posterior(voters.value.votes(hits, n_words).astype(np.int64))
            parts = np.split(bucket, np.cumsum(n_words)[:-1])
            yield {"dense": [r.tolist() for r in dense], "buckets": [np.unique(p).tolist() for p in parts], "n_words": n_words, "target": target, "n": batch.column("n").slice(i, j - i)}

    table = map_batches(sample, describe, "dense array<double>, buckets array<int>, n_words long, target double, n long").toPandas()
    table = table.iloc[np.lexsort([table["n"], table["target"], table["n_words"]])] if len(table) else table
    dense = np.stack(table["dense"]) if len(table) else np.zeros((0, 4 + len(voters.value) - 1))
    lengths = np.array([len(b) for b in table["buckets"]], np.int64)
    owner = np.repeat(np.arange(len(table)), lengths)
    bucket = np.concatenate([*table["buckets"], np.zeros(0)]).astype(np.int64)
    weight = (1 / np.sqrt(np.maximum(table["n_words"].to_numpy(float), 1)))[owner] if len(table) else np.zeros(0)
    fitted = spark.sparkContext.broadcast(fit_classifier(dense, (owner, bucket, weight), table["target"].to_numpy(float), table["n"].to_numpy(float)))

    def score(batch):
        texts = batch.column("text")
        for i, j in batches_of(texts):
            hits, n_words, (words, owner) = voters.value.counts(texts.slice(i, j - i))
            dense, (_, bucket, weight) = features(hits, n_words, words, owner)
            keys, first = np.unique((owner << HASH_BITS) | bucket, return_index=True)
            linear = dense @ fitted.value[0] + np.bincount(owner[first], weights=weight[first] * fitted.value[1][bucket[first]], minlength=j - i)
            chance = 1 / (1 + np.exp(-np.clip(linear, -60, 60)))
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "score": chance, "predicted": chance >= THRESHOLD}

    scored = map_batches(docs, score, "doc_id long, score double, predicted boolean")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))
