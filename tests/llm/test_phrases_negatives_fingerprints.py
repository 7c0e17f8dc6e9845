"""Collocations, hard negatives and fingerprints against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.llm import collocations, fingerprint, hard_negatives, queries

DOCS = "doc_id long, text string, lang string, rank int, n long, path string, hash string, range int"
VECTORS = "vec_id long, embedding array<double>, label int, key string, block int, score long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_collocations", "op12_hard_negatives", "op13_fingerprint"])
def test_matches_sql(spark, sf, name):
    duck = duckdb.connect()
    for file in os.listdir(sf):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    found, expected = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns and len(found) > 0

    def rows(frame):
        frame = frame[columns].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    for column in columns:
        if found[column].dtype.kind == "f" or expected[column].dtype.kind == "f":
            found[column], expected[column] = found[column].astype(float).round(9), expected[column].astype(float).round(9)
        elif found[column].dtype.kind == "i":
            expected[column] = expected[column].astype(found[column].dtype)
    assert rows(found) == rows(expected)


# collocations


def brute_phrases(rows, most_words, least, percent, most):
    f, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    around = collections.Counter()
    for (lang, words), a in often.items():
        for inner in (words[1:], words[:-1]):
            around[lang, inner] = max(around[lang, inner], a)
    scored = collections.defaultdict(list)
    for (lang, words), a in often.items():
        if around[lang, words] and 100 * around[lang, words] >= percent * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        scored[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in scored.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1)
    )


def phrase_rows():
    rng = random.Random(4)
    vocabulary = ["a", "B", "é", "ß", "of", "the", "x\x1fy", "日本", "w" * 300]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\t", "\n"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "de", None, "und", "l a\nng"])) for t in texts]
    rows += [("the end of the line again", "en")] * 15 + [(None, "en"), ("", None), (" ,. \t", "xx"), ("a a a a a a a a a a a a a a", "yy")]
    return rows


@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_phrases_equal_brute_force(spark, most_words):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, 1, 1, "p", "h", 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    found = collocations.mine_phrases(docs, most_words, least=4, most=30).drop("path", "path_at")
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, most_words, 4, 50, 30)


@pytest.mark.parametrize("hot", [[["a", "the"], ["a a", "of the"]], [["a", "b", "é", "of"], []], []])
def test_counts_do_not_depend_on_the_frequent_beginnings(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "frequent_beginnings", lambda docs, most_words: hot)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, 1, 1, "p", "h", 1) for i, (t, lang) in enumerate(rows)], DOCS)
    found = collocations.mine_phrases(docs, 3, least=4, most=30).drop("path", "path_at")
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 3, 4, 50, 30)


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 50)
    texts = ["a b. " * 40, "", "c" * 200 + ". d", "e f", "g " * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cut, owner = collocations._segments(data, offsets)
    assert set(offsets) <= set(cut) and (np.diff(cut) >= 0).all() and len(owner) == len(cut) - 1 > len(texts)
    assert all(collocations.PIECE_BREAK[data[c - 1]] for c in set(cut) - set(offsets))
    assert [texts[o][0] for o, a, b in zip(owner, cut, cut[1:]) if b > a] == [chr(data[a]) if data[a] != 32 else texts[o][0] for o, a, b in zip(owner, cut, cut[1:]) if b > a]
    counts = collections.Counter()
    for a, b in collocations._blocks(cut):
        part = cut[a : b + 1]
        text, phrases, n, *_ = collocations._count_block(data[part[0] : part[-1]], part - part[0], owner[a:b], 3, [])
        for t, phrase, k in zip(text, phrases.to_pylist(), n.tolist()):
            counts[int(owner[a + t]), phrase] += k
    assert counts == {(0, "a b"): 40, (0, "b"): 40, (2, "c" * 200): 1, (2, "d"): 1, (3, "e f"): 1, (3, "f"): 1, (4, "g g g"): 98, (4, "g g"): 1, (4, "g"): 1}


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10**15 - 1, 10**15, 10**15), (10, 10, 10), (3, 10**9, 10**9)]
    table = spark.createDataFrame(cases, "a long, l long, r long")
    found = table.select("a", "l", "r", collocations.score_of("a", "l", "r")).collect()
    assert [s for *_, s in found] == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_paths_of_chains_branches_and_cycles(spark):
    chain = [f"{i} {i + 1} {i + 2}" for i in range(13)]
    branch = ["x y z", "y z p", "y z q", "z q r"]
    cycle = ["u v u", "v u v"]
    edges = spark.createDataFrame([("en", e) for e in chain + branch + cycle] + [("de", chain[4])], "lang string, phrase string")
    found = {(lang, p): (path, at) for lang, p, path, at in collocations.compact_paths(edges, 3).collect()}
    assert [found["en", e] for e in chain] == [(chain[0], k) for k in range(13)]
    assert found["de", chain[4]] == (chain[4], 0) and found["en", "z q r"] == ("y z q", 1)
    assert all(found["en", e] == (e, 0) for e in ["x y z", "y z p", "y z q", *cycle])
    assert len(found) == len(chain) + len(branch) + len(cycle) + 1


def test_phrases_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.mine_phrases(empty).count() == 0
    assert collocations.mine_phrases(spark.createDataFrame([(1, None, None, 1, 1, "", "", 1)], DOCS)).count() == 0


# hard negatives


def brute_negatives(rows, every=100, positives=5, negatives=10):
    usable = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = sorted({(i, lab, tuple(v)) for i, lab, v in usable if i % every == 0})
    out = []
    for i, lab, v in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in usable if j != i)
        for score, j, _ in [s for s in scored if s[2] == lab][:positives]:
            fit = [s for s in scored if s[2] != lab and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(i, j, rank, k, -score, -s) for rank, (s, k, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vector_rows(dim, n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + rng.normal(size=dim) * (i % 3)).round(3).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same, i % 4) for i in range(60)]
    return rows


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_negatives_equal_brute_force(spark, dim):
    rows = vector_rows(dim, 400)
    rows += [(2000, None, 1), (2001, [None] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf")] * dim, 1), (2004, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2005, [], 1), (2100, [1.0], 2), (2200, [0.0] * dim, 3), rows[100], rows[100], rows[3], (200, rows[9][1], 2)]
    table = spark.createDataFrame([(i, v, lab, "k", 1, 2) for i, v, lab in rows], VECTORS).repartition(3)
    expected = brute_negatives(rows)
    assert sorted(map(tuple, hard_negatives.hard_negatives(table).collect())) == expected
    assert sorted(map(tuple, hard_negatives.hard_negatives(table, block=2).collect())) == expected


def test_intervals_hold_every_score():
    rng = np.random.default_rng(1)
    for dim, scale in ((5, 3), (64, 100), (70, 1_000_000)):
        ints = (rng.normal(size=(300, dim)) * scale).astype(np.int64)
        codes, alignments, rest = hard_negatives.encode(ints)
        anchors = hard_negatives.Anchors(np.arange(40), np.zeros(40), ints[:40])
        rows = hard_negatives.Rows(np.arange(300), np.zeros(300), ints, codes, alignments, rest)
        estimate, off = hard_negatives.intervals(*anchors.planes(), rows)
        exact = ints[:40] @ ints.T
        assert (np.abs(exact - estimate) <= off).all()
        assert np.median(off / np.outer(*[np.linalg.norm(x, axis=1) for x in (ints[:40], ints)])) < 0.25


def test_negatives_of_empty_tables_and_large_components(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", 1, 1)], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1, "", 1, 1)], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e30], 1, "", 1, 1)], VECTORS))


# fingerprints


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:13], 16) for w in words]
    windows = [hashes[i : i + 5] for i in range(max(len(hashes) - 4, 1))] if words else []
    return {sum(h * w for h, w in zip(window, (3, 7, 31, 127, 251))) % ((1 << 52) - 47) for window in windows}


def fingerprint_rows():
    rng = random.Random(6)

    def text(n):
        return " ".join(rng.choice(["é", "日本 ", "x"]) + str(rng.randrange(80)) + rng.choice(["", "\n", "\x0b"]) for _ in range(n))

    rows = [(i * 3, text(rng.randrange(60))) for i in range(40)] + [(500, text(3_000)), (499, text(900)), (1 << 62, "One two"), (-5, "one TWO"), (7, None), (8, ""), (10, " \n ")]
    return rows + [(501, rows[3][1])]


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_fingerprints_equal_brute_force(spark, ranges):
    rows = fingerprint_rows()
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "p", "h", 3) for i, t in rows], DOCS).repartition(3)
    found = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs, k=512, ranges=ranges).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        own, sets = brute_set(t), (brute_set(edited), brute_set(following))
        row = found[i]
        assert (row["n_chars"], row["edited_text"]) == (len(t), edited)
        assert row["fingerprint"] == "".join(f"{h:013x}" for h in sorted(own)[:512])
        for name, other in zip(("near_edited", "near_next"), sets, strict=True):
            exact = len(own & other) / len(own | other) if own | other else 1.0
            assert row[name] == pytest.approx(exact, abs=1e-12 if max(len(own), len(other)) < 512 else 0.08)
        assert row["n_shingles_estimate"] == pytest.approx(len(own), rel=1e-12 if len(own) < 512 else 0.15)
    assert found[501]["fingerprint"] == found[9]["fingerprint"]


def test_fingerprints_of_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "z"), (1, None)]
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "p", "h", 3) for i, t in rows], DOCS)
    found = fingerprint.fingerprint_documents(docs).collect()
    assert len(found) == 5 and len({r["fingerprint"] for r in found if r["n_chars"] == 11}) == 1
    nowhere = [r for r in found if r["doc_id"] is None][0]
    assert nowhere["edited_text"] is None and nowhere["near_next"] is None and nowhere["fingerprint"]
    assert [r["near_next"] for r in found if r["doc_id"] == 4 and r["n_chars"] == 11].count(1.0) == 1
    alone = fingerprint.fingerprint_documents(docs.where("doc_id = 1")).collect()
    assert [(r["near_next"], r["near_edited"], r["fingerprint"]) for r in alone] == [(1.0, 1.0, "")]
    assert fingerprint.fingerprint_documents(docs.where("false")).count() == 0


def test_sketches_merge_and_read_back(spark):
    rows = fingerprint_rows()
    docs = spark.createDataFrame([(i, t, None if zlib.crc32(str(i).encode()) % 3 == 0 else "en", 1, 2, "p", "h", 3) for i, t in rows], DOCS)
    made = docs.select("lang", fingerprint.sketch(F.col("text"), 64).alias("sketch"))
    merged = {r["lang"]: r["sketch"] for r in fingerprint.merge_sketches(made, ["lang"], k=64).collect()}
    for lang in (None, "en"):
        whole = set().union(*[brute_set(r["text"]) for r in docs.collect() if r["lang"] == lang])
        assert merged[lang] == sorted(whole)[:64]
    blank = docs.where("text = ''").select("lang", fingerprint.sketch(F.col("text")).alias("sketch"))
    assert [r["sketch"] for r in fingerprint.merge_sketches(blank, ["lang"]).collect()] == [[]]
    back = made.select("sketch", fingerprint.from_fingerprint(fingerprint.as_fingerprint(F.col("sketch"))).alias("back")).collect()
    assert all(r["sketch"] == r["back"] for r in back)


def test_estimates_are_near_and_native(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6_000)]
    pair = spark.createDataFrame([(" ".join(words[:4_000]), " ".join(words[1_000:]))], "a string, b string")
    one, two = (fingerprint.sketch(F.col(c), 512).alias(c) for c in "ab")
    sketches = pair.select(one, two)
    a, b = F.col("a"), F.col("b")
    likeness, inside, count = sketches.select(fingerprint.resemblance(a, b, 512), fingerprint.containment(a, b, 512), fingerprint.distinct_count(b, 512)).first()
    assert likeness == pytest.approx(0.5, abs=0.1) and inside == pytest.approx(0.75, abs=0.1) and count == pytest.approx(4_996, rel=0.15)
    plan = queries.QUERIES["op13_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InPandas", "InArrow", "ExistingRDD"))
    assert pd.notna(likeness)
