"""Text operators against brute force on small fixtures, and their edge cases."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardspan.llm import chat, decontaminate, encoder, line_dedup, near_dup, packing, pii, quality, queries, token_counts, toxicity, url_filter, words
from wardspan.llm.tables import components, distinct_texts, picked, sample_bound

DOCS = "doc_id long, text string, lang string, key string, n_lines int, lost string, others string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="module")
def sample():
    """(doc_id, text): copies, near copies, shared lines, odd rows, a long text."""
    rng = random.Random(8)
    line = "This line is found in many a document, and it is long enough."
    rows = [(i, text_of(rng, rng.randrange(60, 160))) for i in range(1, 30)]
    rows += [(i, rows[i - 30][1] + "\n" + line) for i in range(30, 40)]
    rows += [(40 + k, " ".join(rows[2][1].split()[: -1 - k])) for k in range(4)]
    rows += [(50, rows[4][1]), (51, rows[4][1]), (52, None), (53, ""), (54, " \n\t "), (55, "one two"), (56, "ONE two"), (57, "é" * 45 + "\n" + line.upper() + "  ")]
    rows += [(58, text_of(rng, 6_000)), (59, "\n".join([line] * 3)), (1, rows[0][1]), (None, line), (None, None), (60, "mail me@x.example.com or +1 (555) 555-1234, at 10.0.0.300 10.0.0.7 and 4111 1111 1111 1111")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, sample):
    return spark.createDataFrame([(i, t, "en", "k", 3, "l", "o") for i, t in sample], DOCS)


def empty(docs):
    return docs.where("false")


def test_word_hashes_equal_exactly_equal_words():
    rng = random.Random(1)
    texts = [None, "", "A b\n\x0bc", "x" * 200_000 + " y", "é ü"] + ["".join(rng.choice("abAB \n\té") for _ in range(rng.randrange(60))) for _ in range(200)]
    with np.errstate(over="ignore"):
        hashes, bounds = words.word_hashes(pa.array(texts), lower=True)
    names = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(hashes) == len(names) and len(set(zip(hashes.tolist(), names, strict=True))) == len(set(names)) == len(set(hashes.tolist()))
    assert bounds.tolist() == np.cumsum([0] + [len((t or "").encode().split()) for t in texts]).tolist()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {n: n for e in links for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: find(n) for e in links if e[0] != e[1] for n in e}


def key_of(line):
    return line.strip(" \t\x0b\x0c\r\n").translate(str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower()))


def deduped(sample, min_docs=5):
    held = collections.defaultdict(list)
    for i, text in sample:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            held[key].append(-1 if i is None else i)
    out = []
    for i, text in sample:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 40 or len(held[key_of(x)]) < min_docs or max(held[key_of(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, sample, batches):
    found = [tuple(r) for r in line_dedup.dedup_lines(docs, batches=batches, buckets=2).collect()]
    assert sorted(found, key=str) == sorted(deduped(sample), key=str) and any(r[2] for r in found)
    replaced = line_dedup.replace_lines(docs, buckets=2)
    assert replaced.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in replaced.collect()], key=str) == sorted([(r[0], r[3]) for r in deduped(sample)], key=str)
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, sample):
    named = {i: shingles(t) for i, t in sample if i is not None}
    root = {i: i for i in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in named:
        for b in named:
            both = len(named[a] & named[b])
            if a < b and both and 100 * both >= 75 * len(named[a] | named[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    expected = sorted([(i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in sample], key=str)
    found = near_dup.near_duplicates(docs).collect()
    assert sorted([tuple(r) for r in found], key=str) == expected
    assert sum(not r.kept for r in found) >= 8
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_minhash_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        pool = words.mix(rng.integers(0, 1 << 62, 1_400, dtype=np.uint64))
        one, two = pool[:1_200], pool[200:]
        every = slice(0, near_dup.HASHES + near_dup.SKETCH)
        same = (near_dup.minhashes(one, every) == near_dup.minhashes(two, every)).mean()
    assert abs(same - 1_000 / 1_400) < 0.04


def test_quality_base_columns(spark, docs, sample):
    trusted = spark.createDataFrame([(i, "x") for i in range(1, 20)], "doc_id long, text string")
    rows = quality.quality_rules(docs, trusted).toPandas()
    expected = []
    for i, text in sample:
        text = text or ""
        w = BLANK.findall(text)
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines, again = [x for x in text.split("\n") if BLANK.search(x)], 0
        again = len(lines) - len(set(lines))
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    found = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows.itertuples()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert (rows.kept == (~rows.base_failed & (rows.log_ratio.round(9) >= quality.LEAST))).all()
    assert quality.passing(docs, trusted).columns == docs.columns and quality.passing(docs, trusted).count() == rows.kept.sum()
    assert (quality.quality_rules(docs, empty(trusted)).toPandas().log_ratio == 0).all()
    assert quality.quality_rules(empty(docs), trusted).count() == 0


def test_log_ratio_follows_counts():
    raw, target = np.zeros(quality.BUCKETS, int), np.zeros(quality.BUCKETS, int)
    raw[:3], target[:3] = [100_000, 100_000, 100_000], [100_000, 1_000, 0]
    ratios = quality.log_ratios(raw, target)
    assert ratios[0] > 0 > ratios[1] > ratios[2]


def test_buckets_grow_and_all_trusted_documents_count(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(k, f"u{rng.randrange(1 << 40)} v{k}") for k in range(20_100)] + [(None, "x y"), (20_200, "x y"), (20_201, None)]
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in range(20_100)] * 2, "doc_id long")
    monkeypatch.setattr(quality, "LOAD", 4)
    bits = quality.bits_for(docs)
    assert abs(60_303 / (1 << bits) / 4 - 0.75) < 0.3 and quality.bits_for(docs.limit(100)) == quality.BITS
    sums = quality.bucket_counts(docs, trusted, bits).groupBy().sum("n_raw", "n_target").first()
    assert tuple(sums) == (60_306, 60_300)
    ratios = quality.fit_ratios(docs, trusted).value
    assert len(ratios) == 1 << bits
    monkeypatch.setattr(quality, "MOST_IDS", 0)
    assert (quality.fit_ratios(docs, trusted).value == ratios).all()


def test_token_counts_and_ids_equal_the_library(docs, sample):
    whole = encoder.encoder(encoder.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "a", "foo", "'s", "1", ".", "é", "\t", "\x1f", "\xa0", "ß", "<|endoftext|>", "日本", "😀", " \n", "　", "x" * 1200]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert whole.ids(text) == whole.whole.encode(text, add_special_tokens=False).ids
        assert token_counts.Lengths({"foo": 1}, whole).count(text) == len(whole.ids(text))
    found = sorted([tuple(r) for r in token_counts.count_tokens(docs, limit=100).collect()], key=str)
    ids = [(i, len((t or "").encode()), len(whole.whole.encode(t or "", add_special_tokens=False).ids)) for i, t in sample]
    assert found == sorted([(*r, r[2] > 100) for r in ids], key=str)
    assert token_counts.count_tokens(empty(docs)).count() == 0


def test_packing_is_an_exact_round_trip(docs, sample):
    whole = encoder.encoder(encoder.vocabulary_path("byte_bpe_50k.json"))
    rows = packing.pack(docs, window=256).toPandas()
    sequences = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, part in sequences:
        assert (part.length.cumsum() - part.length == part.offset).all()
        total = int(part.length.sum())
        assert total <= 256 and total & (total - 1) == 0
    pieces = collections.Counter()
    for r in rows.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc_id, part in rows.groupby(rows.doc_id.fillna(-1)):
        texts = [t for i, t in sample if (-1 if i is None else i) == doc_id]
        want = collections.Counter()
        for t in texts:
            want.update([*whole.ids(t or ""), packing.END_ID])
        pieces = collections.Counter(np.frombuffer(b"".join(part.ids), "<u4").tolist())
        assert pieces == want
        if len(texts) == 1:
            joined = b"".join(part.sort_values("start").ids)
            assert joined == np.array([*whole.ids(texts[0] or ""), packing.END_ID], "<u4").tobytes()
    assert packing.pack(empty(docs)).count() == 0


def test_bm25_neighbours_equal_brute_force():
    rng = np.random.default_rng(4)
    lengths = rng.integers(5, 40, 30)
    stream = rng.integers(0, 60, lengths.sum()).astype(np.uint16)
    each = np.split(stream, np.cumsum(lengths)[:-1])
    df = collections.Counter(t for d in each for t in set(d.tolist()))
    whole = np.array([np.log1p((90 - df[t] + t + 0.5) / (df[t] + t + 0.5)) for t in range(60)], np.float32)  # other documents hold them too
    index = packing.Bm25Index(stream, lengths, whole)
    seed = 3
    terms = sorted([t for t in set(each[seed].tolist()) if df[t] > 1], key=lambda t: (-whole[t], t))[: packing.QUERY_TERMS]
    scores = {}
    for k, d in enumerate(each):
        score = 0.0
        for t in terms:
            tf = (d == t).sum()
            score += whole[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * lengths[k] / lengths.mean()))
        if score > 0 and k != seed:
            scores[k] = score
    unused = np.ones(30, bool)
    unused[seed] = False
    found = index.neighbours(seed, unused).tolist()
    assert set(found) == set(scores) and all(scores[a] >= scores[b] - 1e-4 for a, b in zip(found, found[1:], strict=False))


def test_alike_documents_share_shards_and_equal_rows_are_spread(spark):
    rng = random.Random(5)
    topics = [[f"{chr(97 + t)}{rng.randrange(10**6)}" for _ in range(300)] for t in range(6)]
    texts = [" ".join(rng.choices(topics[k % 6], k=60)) for k in range(600)]
    rows = [(k, text) for k, text in enumerate(texts)] + [(7_000, "one and the same row " * 15)] * 400
    table = spark.createDataFrame(rows, "doc_id long, text string")
    width = "<u2"
    coded, idf = packing.encoded(table, encoder.vocabulary_path("byte_bpe_50k.json"), 1 << 16, width)
    df = collections.Counter(t for r in coded.collect() for t in set(np.frombuffer(r.ids, width).tolist()))
    assert all(np.isclose(idf[t], np.log1p((1_000 - n + 0.5) / (n + 0.5)), rtol=1e-5) for t, n in df.items())
    total = coded.agg(F.sum("n")).first()[0]
    placed = packing.dealt(coded, total // 12).toPandas()
    assert len(placed) == 1_000 and placed.n.sum() == total and set(placed.shard) <= set(range(13))
    assert placed.groupby("shard").n.sum().max() < 1.6 * total / 12
    copies = placed[placed.doc_id == 7_000]
    assert copies.shard.nunique() >= len(copies) * copies.n.iloc[0] / (total / 12)
    shard = placed[placed.doc_id < 600].set_index("doc_id").shard
    pairs = [(a, b) for a in range(0, 600, 7) for b in range(600) if a != b and a % 6 == b % 6]
    together = np.mean([shard[a] == shard[b] for a, b in pairs])
    others = np.mean([shard[a] == shard[b] for a in range(0, 600, 7) for b in range(600) if a % 6 != b % 6])
    assert together > 0.3 and others < 0.12


def test_quick_checks_of_texts_equal_the_patterns():
    rng = random.Random(6)
    whole = encoder.encoder(encoder.vocabulary_path("byte_bpe_50k.json"))
    runs = ["x" * 999, "x" * 1000, " " * 999, " " * 1000, "\n" * 1000, " \n" * 600, "é" * 600, "é" * 1000, "\x07", "\x7f", "ok", "日", "ß", "\u0378", ""]
    for _ in range(3_000):
        text = "".join(rng.choices([*runs, " ", "\n", "word"], k=rng.randrange(4)))
        slow = not (encoder.UNUSUAL.search(text) or encoder.LONG_WORD.search(text) or any(s in text for s in whole.special))
        assert whole.usual(text) == slow


def brute_spans(text):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        twice = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and twice % 10 == 0:
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns(docs, sample):
    rng = random.Random(3)
    bits = ["1", "23", "255", "4111111111111111", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "\n", "256", "0", "+1 555 123 4567", "x@y.z", "é"]
    for _ in range(5_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000 + "@") == []
    rows = pii.find_personal_data(docs).collect()
    assert sorted([(r.doc_id, r.base_spans) for r in rows], key=str) == sorted([(i, pii.written(brute_spans(t or ""))) for i, t in sample], key=str)
    assert all(set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(",")) for r in rows)
    assert pii.find_personal_data(empty(docs)).count() == 0


def test_field_learns_labels_and_decodes_exactly():
    rng = random.Random(6)
    table = []
    for _ in range(300):
        table.append(([f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(255)}"], [pii.LABELS.index("B-ip")]))
        table.append(([f"u{rng.randrange(99)}@m.example.com", "77"], [pii.LABELS.index("B-email"), 0]))
        table.append(([f"+{rng.randrange(1, 99)}", f"({rng.randrange(999)})", "555-1234"], [pii.LABELS.index("B-phone"), *[pii.LABELS.index("I-phone")] * 2]))
    field = pii.train(table[:600])
    scores = [[field.scores(w) for w in names] for names, _ in table[600:]]
    decoded = field.decode(scores, most=50)
    assert np.mean([d.tolist() == y for d, (_, y) in zip(decoded, table[600:], strict=True)]) > 0.95
    best, top = None, -np.inf
    for labels in np.ndindex(9, 9, 9):
        path = [0, *labels, 0]
        score = sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(scores[2][t][y] for t, y in enumerate(labels))
        best, top = (labels, score) if score > top else (best, top)
    assert tuple(decoded[2].tolist()) == best


def test_leaks_are_found_and_clean_texts_left(spark, docs, sample):
    rng = random.Random(9)
    items = [(k, text_of(rng, n, 5_000)) for k, n in enumerate([14, 30, 45, 60, 150])] + [(7, None), (8, "")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    extra = [(100 + k, text_of(rng, 80) + " " + t + " " + text_of(rng, 50)) for k, t in items[:5]]
    extra += [(200 + k, text_of(rng, 40) + " " + " ".join(w.upper() for j, w in enumerate(t.split()) if j % 6 != 2) + " " + text_of(rng, 40)) for k, t in items[1:4]]
    leaky = docs.unionAll(spark.createDataFrame([(i, t, "en", "k", 3, "l", "o") for i, t in extra], DOCS))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(leaky, bench).collect()}
    assert found == {(100 + k, k) for k in range(5)} | {(200 + k, k) for k in (1, 2, 3)}
    clean = decontaminate.without_leaks(leaky, bench)
    assert clean.columns == docs.columns and clean.count() == len(sample)
    assert decontaminate.find_leaks(empty(docs), bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_short_items_and_loose_copies_are_candidates(spark):
    rng = random.Random(17)
    items = [(k, text_of(rng, 5 if k < 40 else 40, 5_000)) for k in range(80)]
    rows = []
    for k, text in items:
        body = text.split()
        if k >= 40:
            kept = set(rng.sample(range(40), 25))
            body = [w if j in kept else f"other{rng.randrange(10**6)}" for j, w in enumerate(body)]
        at = rng.randrange(60)
        host = text_of(rng, 120, 5_000).split()
        rows.append((k, " ".join(host[:at] + body + host[at:])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {(k, k) for k, text in items if decontaminate.Passage(decontaminate.tokens(text)).share(decontaminate.tokens(rows[k][1]))}
    assert want <= found and len(want) > 70


def test_pruned_windows_lose_no_candidate(spark, docs):
    rng = random.Random(23)
    bench = spark.createDataFrame([(k, text_of(rng, rng.randrange(5, 70), 900)) for k in range(60)], "item_id long, text string")
    screen = decontaminate.screens(docs, bench)[0]
    noise = np.random.default_rng(5)
    owner = np.sort(noise.integers(0, 40, 9_000))
    sums = (noise.standard_normal((len(owner), screen.space.shape[1])) * noise.exponential(0.1, (len(owner), 1))).astype(np.float32)
    near = noise.integers(0, len(screen.latent), 900)
    sums[:900] += screen.latent[near] * noise.uniform(0.05, 1, (900, 1)).astype(np.float32)
    squares = (sums**2).sum(axis=1) + noise.exponential(0.2, len(owner)).astype(np.float32)
    pruned, whole = (screen.candidates(sums, squares, owner, prune) for prune in (True, False))
    assert 100 < len(whole[0]) < len(owner) * len(screen.passages) / 2
    assert all(np.array_equal(a, b) for a, b in zip(pruned[:2], whole[:2], strict=True)) and np.allclose(pruned[2], whole[2], rtol=1e-4)


def test_buckets_grow_with_distinct_words(spark):
    few = spark.range(200).selectExpr("concat('a', id % 7) AS text")
    many = spark.range(1 << 14).selectExpr("array_join(transform(sequence(0, 127), k -> concat('w', id * 128 + k)), ' ') AS text")
    assert decontaminate.bits_for(few) == decontaminate.bits_for(few.where("false")) == decontaminate.BITS
    assert decontaminate.bits_for(many) in (16, 17)


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate.Passage.places(a), len(a), b) == table[-1, -1]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = "idiot moron loser trash scum pathetic".split()
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        body = text_of(rng, 60).split()
        for _ in range(4 if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(bad if i % 12 else ["grumfel", "grumfig", "grumfox"]))
        rows.append((i, " ".join(body), i))
        labels.append((i, int(toxic), "x"))
    rows += [(900, None, 0), (901, "", 0), (None, "idiot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600))
    assert np.mean([scored[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert scored[900].score < 0.5 and scored[901].predicted == 0 and not scored[None].held_out
    assert toxicity.score_toxicity(docs.where("false"), marks).count() == 0


def test_toxicity_with_a_word_common_in_clean_texts(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(2_400):
        toxic, everyday = i % 6 == 0, i % 6 and i % 20 == 1
        body = text_of(rng, 60).split()
        for word in (rng.choices("idiot moron loser trash scum pathetic".split(), k=4) if toxic else ["kill"] if everyday else []):
            body.insert(rng.randrange(len(body)), word)
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for known in (marks, marks.where("doc_id < 600")):
        scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
        held = [i for i in range(2_400) if scored[i].held_out]
        assert not any(scored[i].predicted for i in held if i % 6 and i % 20 == 1)
        assert np.mean([scored[i].predicted == (i % 6 == 0) for i in held]) > 0.97


def test_training_sample_holds_distinct_texts(spark):
    rows = [("hot",)] * 300 + [(None,)] * 50 + [(f"text {k}",) for k in range(200)]
    docs = spark.createDataFrame(rows, "text string")
    every = {r.text: r.n for r in toxicity.training_sample(docs, 1, 10_000).collect()}
    assert every == {"hot": 300, None: 50, **{f"text {k}": 1 for k in range(200)}}
    assert toxicity.training_sample(docs, 1, 40).count() == 40


def test_samples_never_vanish(spark):
    """A share far below 2^-20 still picks its part of the hashes; copies of one text count once."""
    for total, most in ((10**11, 20_000), (10**14, 2_000), (10**18, 1)):
        assert abs(sample_bound(total, most) / 2**63 * total / most - 1) < 0.2
    assert sample_bound(5, 10) == sample_bound(0, 10) == 1 << 63
    hashes = F.xxhash64("id")
    assert spark.range(2_000_000).where(picked(hashes, 2_000_000_000, 1_000_000)).count() == pytest.approx(1_000, rel=0.2)
    copies = spark.range(20_000).select(F.lit("one and the same text").alias("text"))
    order = F.xxhash64(F.lit(7), "text")
    assert copies.where(picked(order, distinct_texts(copies, order), 100)).count() == 20_000
    assert distinct_texts(copies.where("false"), order) == 0


def test_patterns_see_every_text():
    patterns = [re.compile(p) for p in toxicity.PATTERNS.values()]
    voters = toxicity.Voters([(0, toxicity.hashes_of(words.split())) for words in toxicity.LEXICONS.values()], patterns)
    rng = random.Random(12)
    marks = "idiots IDİOTS ıdiot morons loser losers clowns scum tra\u017fh pathetic worthless stupid disgusting lo\u017fers".split()
    texts = ["you are all idiots", None, "", "They were LOSERS", "a quiet day"]
    texts += [" ".join(rng.choice([*marks, "you", "they", "w", "x."]) for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    hits, n_words, _ = voters.counts(pa.array(texts))
    found = [[sum(1 for _ in p.finditer(t or "")) for p in patterns] for t in texts]
    assert hits[:, len(voters.lists) :].tolist() == found
    votes = voters.votes(hits, n_words)
    assert hits[0, : len(voters.lists)].sum() == 0 and votes[0, len(voters.lists)] == 1 and votes[0, -1] == -1
    assert votes[4, -1] == votes[1, -1] == 0


def test_urls(spark):
    rows = [(k, f"http{'s' * (k % 2)}://H{k}.{host}/{lang}/{k}?a=1&b={k}", "p") for k, (host, lang) in enumerate([(h, x) for h in ("example.net", "example.com", "example.org", "other.net") for x in ("en", "de", "fr")] * 12)]
    rows += [(900, None, "p"), (901, "no scheme", "p"), (902, "http://A.net", "p"), (903, "x://a.net/", "p"), (904, "http://example.com?q/de/", "p"), (905, "http://notexample.com/de/", "p"), (906, "http://" + "a" * 5_000 + ".org/fr/x#y", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string")
    found = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert (found[900].host, found[901].path, found[902].rule, found[903].rule, found[904].path, found[905].rule, found[906].rule) == ("", "", None, "net/", "", None, "org/fr/")
    verdicts = dict(url_filter.RULES)
    for k, url, _ in rows[:144]:
        host, path = re.match(r"https?://([^/]*)([^?]*)", url).groups()
        fit = [r for r in verdicts if (host.lower() == r.split("/")[0] or host.lower().endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule = max(fit, key=len, default=None)
        assert found[k].rule == rule and found[k].host == host.lower() and found[k].path == path
        assert found[k].verdict == verdicts[rule] if rule else found[k].verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_chat_recovers_roles_over_chunks(spark):
    rng = random.Random(7)
    rows = []
    for conv, n in [(1, 400), *[(k, 6) for k in range(2, 40)]]:
        for turn in range(n):
            role = ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, text_of(rng, 6 if role == "user" else 30) + ("?" if role == "user" else ".")))
    truth = {(c, t): r for c, t, r, _ in rows}
    hidden = [(c, t, None if rng.random() < 0.2 else r, x, 1) for c, t, r, x in rows]
    hidden += [(None, 3, "user", "lost", 1), (5, None, None, None, 1), (900, 0, None, "User: hi\nAssistant: hello", 1)]
    table = spark.createDataFrame(hidden, "conv_id long, turn long, role string, text string, part int")
    found = chat.format_conversations(table).collect()
    assert len(found) == len(hidden)
    known = [r for r in found if (r.conv_id, r.turn) in truth]
    assert np.mean([r.role == truth[r.conv_id, r.turn] for r in known]) > 0.97
    written = next(r for r in found if r.conv_id == 900)
    assert written.rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>" and written.n_blocks == 2
    assert chat.format_conversations(table.where("false")).count() == 0


def test_chat_cuts_a_hot_turn_by_rows(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(7, 0, rng.choice(["user", "assistant", None]), text_of(rng, rng.randrange(3, 20))) for _ in range(600)] + [(7, 0, "user", "again?")] * 600
    rows += [(k, t, ("user", "assistant")[t % 2], text_of(rng, 5)) for k in range(20, 60) for t in range(5)] + [(None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_conversations(table).collect()
    monkeypatch.setattr(chat, "PART_ROWS", 64)
    monkeypatch.setattr(chat, "FAN", 4)
    keyed = table.where("conv_id IS NOT NULL").selectExpr("*", "xxhash64(role, 2, text) AS row", "xxhash64(monotonically_increasing_id()) AS tie")
    sizes = [r["count"] for r in chat.in_parts(keyed).groupBy("part").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 4 * 64 and sum(sizes) == len(rows) - 1
    cut = chat.format_conversations(table).collect()
    assert sorted(str((r.conv_id, r.turn, r.given_role)) for r in cut) == sorted(str((r.conv_id, r.turn, r.given_role)) for r in whole)
    model, hot = chat.fit(keyed), keyed.where("conv_id = 7").orderBy("row").collect()

    def score(found):
        role_of = {(r.given_role, r.rendered.split("\n")[1]): chat.ROLES.index(r.role) for r in found if r.conv_id == 7}
        path = [role_of[r.role, r.text] for r in hot]
        shown = [chat.read_lines(r.role, r.text, r.turn)[0] for r in hot]
        total = model.start[path[0]] + sum(model.change[a, b] for a, b in zip(path, path[1:], strict=False))
        return total + sum(model.emission(line[1], line[3])[role] for line, role in zip(shown, path, strict=True))

    assert abs(score(cut) - score(whole)) < 1e-6


def test_chunked_viterbi_equals_whole(spark):
    rng = np.random.default_rng(3)
    n = len(chat.ROLES)
    tables = [np.log(rng.dirichlet(np.ones(k), n)) for k in chat.FEATURES.values()]
    model = chat.Model(np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n)), np.where(np.eye(n, dtype=bool), 0.0, -1.0), np.log(np.full((n, n), 1 / n)), tables)
    lines = [(-1, bool(rng.integers(2)), tuple(int(rng.integers(k)) for k in chat.FEATURES.values())) for _ in range(30)]
    whole = chat.decode(model, lines, None, None)
    best = chat.chunk_matrix(model, lines[:10])[-1]
    joint = best[:, None] + chat.chunk_matrix(model, lines[10:])[:-1]
    border, last = np.unravel_index(joint.argmax(), joint.shape)
    assert chat.decode(model, lines[:10], None, int(border)) + chat.decode(model, lines[10:], int(border), int(last)) == whole


def test_line_dedup_sql_counts_rows_as_the_operator_does(docs, sample):
    """Repeated ids are documents of their own in both, whichever of them hold the line."""
    line = "A line of more than forty code points that five rows of a table hold."
    rows = [(1, line), (2, line + "\nb"), (3, line), (4, line), (4, "c\n" + line), (9, "alone")]
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    expected = con.execute(queries.LINE_DEDUP_SQL).fetchall()
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    found = [tuple(r) for r in line_dedup.dedup_lines(table, buckets=2).withColumn("kept_text", kept).collect()]
    assert sorted(found) == sorted(expected) and sum(r[2] for r in found) == 3
