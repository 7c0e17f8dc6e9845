"""URL filters: explicit rules first, gradient-boosted trees on lexical features for all other URLs.

The trees learn from the URLs that a rule decides, on a bounded sample. Their features are lexical: lengths, depth, digit
ratio, entropy, parameter counts, and how often labelled URLs with the same host suffix are blocked.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import map_batches
from wardspan.session import write_stage

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUFFIX_BUCKETS = 1024
SAMPLE_URLS = 20_000
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "parameters", "entropy", "host_entropy", "longest_run", "secure")
HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def host_and_path(url: str | None) -> tuple[str, str]:
    found = HOST.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def entropy(text: str) -> float:
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=1)
    share = counts[counts > 0] / max(1, counts.sum())
    return float(-(share * np.log2(share)).sum())


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The FEATURES of one URL."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(map(url.count, "0123456789"))
    return [
        len(url),
        len(host),
        len(path),
        len([part for part in path.split("/") if part]),
        host.count(".") + 1,
        digits / max(1, len(url)),
        host.count("-"),
        len([p for p in query.split("&") if p]),
        entropy(url),
        entropy(host),
        max(map(len, re.split(r"[^A-Za-z0-9]+", url))),
        float(url.startswith("https:")),
    ]


def rule_for(host: str, path: str, rules=RULES) -> str | None:
    """The longest rule that fits the host (or a parent domain) and begins the path."""
    fitting = []
    for rule, _ in rules:
        domain, slash, rest = rule.partition("/")
        if f".{host}".endswith(f".{domain}") and path.startswith(slash + rest):
            fitting.append(rule)
    return max(fitting, key=len, default=None)


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, lexical, and the host's last one and two labels as buckets."""

    def work(batch):
        urls = batch.column("url").to_pylist()
        split = [host_and_path(url) for url in urls]
        yield {
            "page_id": batch.column("page_id"),
            "host": [h for h, _ in split],
            "path": [p for _, p in split],
            "rule": [rule_for(h, p, rules) for h, p in split],
            "lexical": [lexical(u, h, p) for u, (h, p) in zip(urls, split, strict=True)],
        }

    schema = "page_id long, host string, path string, rule string, lexical array<double>"
    rows = map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), work, schema)
    bucket = lambda n: F.pmod(F.xxhash64(F.substring_index("host", ".", -n)), F.lit(SUFFIX_BUCKETS)).cast("int")
    return rows.withColumn("suffix1", bucket(1)).withColumn("suffix2", bucket(2))


def suffix_rates(labelled: DataFrame, column: str) -> Column:
    """Smoothed share of blocked among the labelled URLs of the row's suffix bucket, as a lookup in SUFFIX_BUCKETS numbers."""
    sums = labelled.groupBy(column).agg(F.sum("label").alias("blocked"), F.count("*").alias("n")).toPandas()
    blocked, n = np.zeros(SUFFIX_BUCKETS), np.zeros(SUFFIX_BUCKETS)
    blocked[sums[column]], n[sums[column]] = sums["blocked"], sums["n"]
    overall = blocked.sum() / max(1, n.sum())
    rates = (blocked + 4 * overall) / (n + 4)
    return F.get(F.array(*map(F.lit, rates.tolist())), F.col(column))


def judge_urls(pages: DataFrame, rules=RULES, sample_urls: int = SAMPLE_URLS, trees: int = 12, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    Needs page_id and url, ignores other columns. A URL that a rule fits has the rule's verdict. The trees judge all
    others: they are trained on at most `sample_urls` of the URLs that rules decide (in the order of a hash) and block at
    a probability of one half or more (block_score). Without both verdicts among the labelled URLs the others get the
    only verdict there is, or allow. Null URLs and URLs without `://` have an empty host and path. Repeated rows are
    judged each; an empty table gives an empty table.
    """
    verdicts = dict(rules)
    rows = write_stage(parsed(pages, rules), "urls")
    label = F.when(F.col("rule").isin([r for r, v in rules if v == "block"]), 1.0).otherwise(0.0)
    labelled = rows.where("rule IS NOT NULL").withColumn("label", label)
    rates = [suffix_rates(labelled, column) for column in ("suffix1", "suffix2")]
    features = F.concat("lexical", F.array(*rates))
    sample = labelled.orderBy(F.xxhash64("host", "path", "page_id"), "page_id").limit(sample_urls).select("label", array_to_vector(features).alias("features"))
    sample = write_stage(sample.repartition(4), "labelled-urls")
    seen = [row["label"] for row in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        scored = rows.withColumn("block_score", F.lit(seen[0] if seen else 0.0))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=8, featureSubsetStrategy="all").fit(sample)
        scored = model.transform(rows.withColumn("features", array_to_vector(features)))
        scored = scored.withColumn("block_score", F.get(vector_to_array("probability"), F.lit(1)))
    given = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        given = F.when(F.col("rule") == rule, verdict).otherwise(given)
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(given, learned).alias("verdict"), F.col("block_score").cast("double").alias("block_score"))
