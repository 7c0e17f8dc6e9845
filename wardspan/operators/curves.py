"""Rank statistics on score histograms: midranks, ROC curves, DeLong variances and tests.

Every operator first counts rows per distinct score, then takes running totals over score ranges, so
no task ever sorts a whole site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.stats import normal_quantile, ratio, two_sided_p
from wardspan.operators.scale import lookup_join, range_splits, running_totals


def score_histogram(scores: DataFrame, by: Sequence[str], score: str = "p", label: str = "label", weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    one = F.col(weight) if weight else F.lit(1)
    return scores.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, one).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, one).otherwise(0)).alias("neg"),
    )


def ranked_histogram(scores: DataFrame, by: Sequence[str], score: str = "p", label: str = "label", splits: Sequence[float] | None = None, weight: str | None = None) -> DataFrame:
    """The histogram with the positives and negatives below each score."""
    histogram = score_histogram(scores, by, score, label, weight)
    return running_totals(histogram, by, score, ["pos", "neg"], splits=range_splits(scores, score, splits))


def midrank(df: DataFrame, by: Sequence[str], score: str = "p", splits: Sequence[float] | None = None) -> DataFrame:
    """1-based rank of every row, the mean rank where scores tie."""
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count("*").alias("n"))
    placed = running_totals(counts, by, score, ["n"], splits=range_splits(df, score, splits))
    ranks = placed.select(*by, score, (F.col("n_before") + (F.col("n") + 1) / 2).alias("midrank"))
    return df.join(ranks, [*by, score])


def weighted_tie_ranks(df: DataFrame, by: Sequence[str], score: str, weight: str, key: str, splits: Sequence[float] | None = None, key_splits: Sequence[float] | None = None) -> DataFrame:
    """Per distinct score, the mean of the running weight inside its tie block; ties run in key order."""
    by = list(by)
    numbered = running_totals(
        df.select(*by, score, key, F.col(weight).cast("double").alias("_w"), F.lit(1).alias("_one")),
        [*by, score],
        key,
        ["_one"],
        splits=range_splits(df, key, key_splits),
    )
    blocks = numbered.groupBy(*by, score).agg(
        F.count("*").alias("_n"),
        F.sum("_w").alias("_weight"),
        F.sum(F.col("_w") * F.col("_one_before")).alias("_late"),
    )
    placed = running_totals(blocks, by, score, ["_weight"], splits=range_splits(df, score, splits))
    return placed.select(
        *by, score, (F.col("_weight_before") + F.col("_weight") - F.col("_late") / F.col("_n")).alias("midrank")
    )


def midrank_weighted(df: DataFrame, by: Sequence[str], score: str = "p", weight: str = "weight", key: str = "encounter_id", splits: Sequence[float] | None = None, key_splits: Sequence[float] | None = None) -> DataFrame:
    """Weighted midrank of every row."""
    return df.join(weighted_tie_ranks(df, by, score, weight, key, splits, key_splits), [*by, score])


def ground_truth(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Positive and negative counts, and whether both classes and nothing else occur."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        (
            (F.count_if(F.col(label) == 1) > 0)
            & (F.count_if(F.col(label) == 0) > 0)
            & (F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)) == 0)
        ).alias("valid"),
    )


def roc_curve(scores: DataFrame, by: Sequence[str], score: str = "p", label: str = "label", splits: Sequence[float] | None = None) -> DataFrame:
    """`(by, idx, threshold, fpr, tpr)` in descending threshold order.

    Point 0 is (0, 0) without a threshold. Interior points on a straight piece are dropped: those where
    the next distinct score adds the same counts.
    """
    by = list(by)
    splits = range_splits(scores, score, splits)
    points = running_totals(
        score_histogram(scores, by, score, label),
        by,
        score,
        ["pos", "neg"],
        descending=True,
        splits=splits,
        next_values=["pos", "neg"],
    )
    is_first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    corner = (
        is_first
        | F.col("pos_next").isNull()
        | (F.col("pos_next") != F.col("pos"))
        | (F.col("neg_next") != F.col("neg"))
    )
    kept = points.where(corner).withColumn("_one", F.lit(1))
    indexed = running_totals(kept, by, score, ["_one"], descending=True, splits=splits)
    totals = ground_truth(scores, by, label).select(*by, "n_pos", "n_neg")
    curve = lookup_join(indexed, totals, by).select(
        *by,
        (F.col("_one_before") + 1).cast("long").alias("idx"),
        F.col(score).alias("threshold"),
        F.expr(ratio("neg_before + neg", "n_neg")).alias("fpr"),
        F.expr(ratio("pos_before + pos", "n_pos")).alias("tpr"),
    )
    zero = F.lit(0.0)
    origin = totals.select(
        *by,
        F.lit(0).cast("long").alias("idx"),
        F.lit(None).cast("double").alias("threshold"),
        F.when(F.col("n_neg") > 0, zero).alias("fpr"),
        F.when(F.col("n_pos") > 0, zero).alias("tpr"),
    )
    return origin.unionByName(curve)


def _spread(weight: str, a: str, b: str) -> str:
    """Sample covariance of two columns that stand for `weight` equal rows each."""
    joint, means = f"sum({weight} * {a} * {b})", f"sum({weight} * {a}) * sum({weight} * {b})"
    return ratio(f"{joint} - {means} / greatest(sum({weight}), 1)", f"sum({weight}) - 1")


def _variance(wins: str, losses: str, m: str = "sum(pos)", n: str = "sum(neg)") -> str:
    """DeLong (co)variance from the two spreads of unscaled placements."""
    m, n = f"double({m})", f"double({n})"
    return f"{ratio(wins, f'{m} * {n} * {n}')} + {ratio(losses, f'{n} * {m} * {m}')}"


WINS = "double(neg_before + neg / 2)"
LOSSES = "double(pos_before + pos / 2)"


def delong_aggregates() -> list[Column]:
    """`n_pos, n_neg, auc, auc_var` as aggregates over a ranked histogram."""
    return [
        F.expr("bigint(sum(pos)) AS n_pos"),
        F.expr("bigint(sum(neg)) AS n_neg"),
        F.expr(ratio(f"sum(pos * {WINS})", "double(sum(pos)) * sum(neg)") + " AS auc"),
        F.expr(_variance(_spread("pos", WINS, WINS), _spread("neg", LOSSES, LOSSES)) + " AS auc_var"),
    ]


def delong_auc(scores: DataFrame, by: Sequence[str], score: str = "p", label: str = "label", splits: Sequence[float] | None = None) -> DataFrame:
    """`(by, n_pos, n_neg, auc, auc_var)`; null where a class is absent."""
    ranked = ranked_histogram(scores, by, score, label, splits)
    return ranked.groupBy(*by).agg(*delong_aggregates())


def auc_bounds(auc: Column, variance: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Normal interval of an AUC, to three digits; null without a variance."""
    half = F.lit(normal_quantile(level)) * F.sqrt(F.when(variance < 0, 0.0).otherwise(variance))
    return F.round(auc - half, 3), F.round(auc + half, 3)


def auc_ci(scores: DataFrame, by: Sequence[str], level: float = 0.95, **options) -> DataFrame:
    low, high = auc_bounds(F.col("auc"), F.col("auc_var"), level)
    return delong_auc(scores, by, **options).withColumns({"auc_lo": low, "auc_hi": high})


def delong_weighted(df: DataFrame, by: Sequence[str], score: str = "p", label: str = "label", weight: str = "weight", key: str = "encounter_id", splits: Sequence[float] | None = None, key_splits: Sequence[float] | None = None) -> DataFrame:
    """Sample-weighted AUC; the covariance of the placements stays unweighted."""
    by = list(by)

    def ranks(rows: DataFrame, name: str) -> DataFrame:
        return weighted_tie_ranks(rows, by, score, weight, key, splits, key_splits).withColumnRenamed("midrank", name)

    blocks = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
        F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0.0)).alias("pos_w"),
        F.sum(F.when(F.col(label) == 0, F.col(weight)).otherwise(0.0)).alias("neg_w"),
    )
    merged = (
        blocks.join(ranks(df, "tz"), [*by, score])
        .join(ranks(df.where(F.col(label) == 1), "tx"), [*by, score], "left")
        .join(ranks(df.where(F.col(label) == 0), "ty"), [*by, score], "left")
    )
    ranked = merged.selectExpr(
        *by,
        "pos",
        "neg",
        "pos_w",
        "neg_w",
        "if(pos > 0, tz - tx, 0D) AS wins",
        "if(neg > 0, tz - ty, 0D) AS losses",
    )
    won = ratio(_spread("pos", "wins", "wins"), "sum(neg_w) * sum(neg_w) * sum(pos)")
    lost = ratio(_spread("neg", "losses", "losses"), "sum(pos_w) * sum(pos_w) * sum(neg)")
    return ranked.groupBy(*by).agg(
        F.expr(ratio("sum(pos_w * wins)", "sum(pos_w) * sum(neg_w)") + " AS auc"),
        F.expr(f"{won} + {lost} AS auc_var"),
    )


def delong_test(pairs: DataFrame, by: Sequence[str], one: str = "p1", two: str = "p2", label: str = "label", splits: Sequence[float] | None = None) -> DataFrame:
    """Compare the AUCs of two score columns of the same rows.

    The variance of the difference comes from the differences of the placements, row by row, so it is exactly 0 where
    both scores rank alike, however many rows there are; `identical` marks that, z is null there and the p value 1.
    """
    by = list(by)
    cells = pairs.groupBy(*by, one, two).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )

    def placements(score: str, tag: str) -> DataFrame:
        histogram = cells.groupBy(*by, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        ranked = running_totals(
            histogram, by, score, ["pos", "neg"], splits=range_splits(pairs, score, splits)
        )
        return ranked.select(
            *by,
            score,
            F.expr(WINS).alias(f"wins{tag}"),
            F.expr(LOSSES).alias(f"losses{tag}"),
        )

    placed = cells.join(placements(one, "1"), [*by, one]).join(placements(two, "2"), [*by, two])
    placed = placed.withColumns({"wins_gap": F.expr("wins1 - wins2"), "losses_gap": F.expr("losses1 - losses2")})

    def covariance(a: str, b: str) -> str:
        return _variance(_spread("pos", f"wins{a}", f"wins{b}"), _spread("neg", f"losses{a}", f"losses{b}"))

    pairs_of_classes = "double(sum(pos)) * sum(neg)"
    tested = placed.groupBy(*by).agg(
        F.expr(ratio("sum(pos * wins1)", pairs_of_classes) + " AS auc1"),
        F.expr(ratio("sum(pos * wins2)", pairs_of_classes) + " AS auc2"),
        F.expr(covariance("1", "1") + " AS var1"),
        F.expr(covariance("2", "2") + " AS var2"),
        F.expr(covariance("1", "2") + " AS cov12"),
        F.expr(covariance("_gap", "_gap") + " AS spread"),
    )
    spread = F.col("spread")
    z = F.when(spread > 0, F.abs(F.col("auc1") - F.col("auc2")) / F.sqrt(spread))
    return (
        tested.withColumn("identical", spread <= 0)
        .withColumn("z", z)
        .withColumn("p_value", F.when(F.col("identical"), 1.0).otherwise(two_sided_p(F.col("z"))))
        .drop("spread")
    )
