"""Registered queries of the text operators over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.chat import format_conversations
from wardspan.llm.collocations import mine_phrases
from wardspan.llm.decontaminate import find_leaks
from wardspan.llm.fingerprint import fingerprint_documents
from wardspan.llm.hard_negatives import hard_negatives
from wardspan.llm.line_dedup import dedup_lines
from wardspan.llm.near_dup import near_duplicates
from wardspan.llm.packing import pack
from wardspan.llm.pii import find_personal_data
from wardspan.llm.quality import quality_rules
from wardspan.llm.token_counts import count_tokens
from wardspan.llm.toxicity import score_toxicity
from wardspan.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = ("n_email", "n_ip", "n_card", "n_phone")
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint_documents(table(spark, sf_dir, "documents"))
    names = ("fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained", "n_shingles_estimate")
    return made.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_chat_format,
        op3_pii,
        op4_token_counts,
        op5_near_dedup,
        op6_decontaminate,
        op7_toxicity,
        op8_url_filter,
        op9_quality_rules,
        op10_packing,
        op11_collocations,
        op12_hard_negatives,
        op13_fingerprint,
    )
}

LINE_DEDUP_SQL = r"""
WITH listed AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM listed),
keyed AS (
  SELECT *, translate(trim(line, E' \t\x0b\x0c\r\n'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each
),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
),
judged AS (
  SELECT keyed.*, (common.key IS NOT NULL AND common.keeper <> keyed.doc_id) AS lost
  FROM keyed LEFT JOIN common ON keyed.key = common.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

#: Words, shingle sets and all pairs that share a shingle; components by the smallest id reachable.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE spaced AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle
  FROM spaced
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION
  SELECT start, edges.b FROM reached JOIN edges ON edges.a = reached.node
),
least AS (SELECT start AS doc_id, min(node) AS component_id FROM reached GROUP BY start)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.doc_id = d.doc_id
"""

#: Sketches of 128 hashes: 52-bit word hashes, weighted sums modulo a prime, compared below the last common hash.
FINGERPRINT_SQL = r"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS body, lead(coalesce(text, '')) OVER falling AS following, first_value(coalesce(text, '')) OVER falling AS first_body
  FROM documents WINDOW falling AS (ORDER BY doc_id DESC)
),
edited AS (
  SELECT doc_id, body, coalesce(following, first_body) AS following, length(body) AS n_chars,
    body[1:length(body) - length(body) // 3] || coalesce(following, first_body)[1:length(body) // 3] AS edited_text
  FROM ordered
),
texts AS (
  SELECT doc_id, 1 AS kind, body AS t FROM edited UNION ALL SELECT doc_id, 2, following FROM edited UNION ALL SELECT doc_id, 3, edited_text FROM edited
),
hashed AS (
  SELECT doc_id, kind, list_transform(list_filter(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ 	-
]+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[1:13])::BIGINT) AS h
  FROM texts
),
sketched AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(h) = 0 THEN [] ELSE
    list_transform(range(1, greatest(len(h) - 4, 1) + 1), lambda i: (h[i] * 3 + coalesce(h[i + 1], 0) * 7 + coalesce(h[i + 2], 0) * 31
      + coalesce(h[i + 3], 0) * 127 + coalesce(h[i + 4], 0) * 251) % 4503599627370449) END))[1:128] AS s
  FROM hashed
),
beside AS (
  SELECT o.doc_id, o.s AS own, e.s AS edited, n.s AS following,
    least(CASE WHEN len(o.s) >= 128 THEN o.s[128] END, CASE WHEN len(e.s) >= 128 THEN e.s[128] END) AS edited_limit,
    least(CASE WHEN len(o.s) >= 128 THEN o.s[128] END, CASE WHEN len(n.s) >= 128 THEN n.s[128] END) AS next_limit
  FROM sketched o JOIN sketched n ON n.doc_id = o.doc_id AND n.kind = 2 JOIN sketched e ON e.doc_id = o.doc_id AND e.kind = 3
  WHERE o.kind = 1
),
counted AS (
  SELECT *, len(list_intersect(own, edited)) AS both_edited, len(list_intersect(own, following)) AS both_next,
    len(list_filter(own, lambda x: edited_limit IS NULL OR x <= edited_limit)) AS own_edited,
    len(list_filter(edited, lambda x: edited_limit IS NULL OR x <= edited_limit)) AS n_edited,
    len(list_filter(own, lambda x: next_limit IS NULL OR x <= next_limit)) AS own_next,
    len(list_filter(following, lambda x: next_limit IS NULL OR x <= next_limit)) AS n_next
  FROM beside
)
SELECT c.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.edited_text) AS edited_sha256,
  array_to_string(list_transform(own, lambda x: printf('%013x', x)), '') AS fingerprint,
  array_to_string(list_transform(edited, lambda x: printf('%013x', x)), '') AS edited_fingerprint,
  CASE WHEN own_edited + n_edited = both_edited THEN 1.0 ELSE both_edited::DOUBLE / (own_edited + n_edited - both_edited) END AS near_edited,
  CASE WHEN own_next + n_next = both_next THEN 1.0 ELSE both_next::DOUBLE / (own_next + n_next - both_next) END AS near_next,
  CASE WHEN own_edited = 0 THEN 1.0 ELSE both_edited::DOUBLE / own_edited END AS contained,
  CASE WHEN len(own) < 128 THEN len(own)::DOUBLE ELSE 127 / ((own[128]::DOUBLE + 1) / 4503599627370449.0::DOUBLE) END AS n_shingles_estimate
FROM counted c JOIN edited e ON e.doc_id = c.doc_id
"""

#: Counts of all phrases; a path is followed back from edge to edge through nodes with one way in and one way out.
COLLOCATIONS_SQL = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
spaced AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM spaced, range(1, 4) lengths(k) WHERE len(w) >= k
),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 10),
cuts AS (
  SELECT lang, words, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
  FROM often, range(1, 3) places(k) WHERE words > k
),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.first_part JOIN often y ON y.lang = c.lang AND y.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
),
edges AS (SELECT lang, phrase, f, w[1] || ' ' || w[2] AS source, w[2] || ' ' || w[3] AS target FROM often WHERE words = 3),
heaviest AS (
  SELECT lang, phrase, max(f) AS f FROM (SELECT lang, source AS phrase, f FROM edges UNION ALL SELECT lang, target, f FROM edges) GROUP BY ALL
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN heaviest h ON h.lang = s.lang AND h.phrase = s.phrase AND 100 * h.f >= 50 * s.a AND s.words = 2
  WHERE h.phrase IS NULL QUALIFY rank <= 2000
),
steps AS (
  SELECT e.lang, min(e.phrase) AS before, min(o.phrase) AS phrase
  FROM (SELECT lang, target, min(phrase) AS phrase FROM edges GROUP BY ALL HAVING count(*) = 1) e
  JOIN (SELECT lang, source, min(phrase) AS phrase FROM edges GROUP BY ALL HAVING count(*) = 1) o ON o.lang = e.lang AND o.source = e.target
  GROUP BY e.lang, e.target
),
followed AS (
  SELECT lang, phrase, phrase AS path, 0::BIGINT AS path_at FROM edges e WHERE NOT EXISTS (FROM steps s WHERE s.lang = e.lang AND s.phrase = e.phrase)
  UNION ALL
  SELECT s.lang, s.phrase, f.path, f.path_at + 1 FROM followed f JOIN steps s ON s.lang = f.lang AND s.before = f.phrase
),
paths AS (
  SELECT e.lang, e.phrase, coalesce(f.path, e.phrase) AS path, coalesce(f.path_at, 0) AS path_at
  FROM edges e LEFT JOIN followed f ON f.lang = e.lang AND f.phrase = e.phrase
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::BIGINT AS n, r.score, p.path, p.path_at
FROM ranked r JOIN totals t ON t.lang = r.lang LEFT JOIN paths p ON p.lang = r.lang AND p.phrase = r.phrase
"""

HARD_NEGATIVES_SQL = r"""
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER best)::INTEGER AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER best <= 10
"""

ORACLE_SQL = {"op11_collocations": COLLOCATIONS_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL, "op1_line_dedup": LINE_DEDUP_SQL, "op5_near_dedup": NEAR_DEDUP_SQL, "op13_fingerprint": FINGERPRINT_SQL}
