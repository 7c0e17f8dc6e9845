"""Confusion metrics, calibration sweeps and the full evaluation row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.stats import exact_sign_p, log_loss_term, number, ratio, wilson_bounds
from wardspan.functions.text import format_auc_ci, format_percent_ci
from wardspan.operators.curves import auc_bounds, delong_aggregates, ranked_histogram
from wardspan.operators.scale import lookup_join

GRID = 500
COMPANION = {"recall": "precision", "precision": "recall", "f1": "f1"}
RATES = ["sensitivity", "specificity", "accuracy", "precision", "npv"]


def confusion_counts(p: str = "p", label: str = "label", threshold: str = "threshold") -> list[Column]:
    """The four cells at `p > threshold`; null for a group without a threshold."""
    hit = f"{p} > {threshold}"
    cells = {"tp": f"{label} = 1 AND {hit}", "fp": f"{label} = 0 AND {hit}", "fn": f"{label} = 1 AND NOT {hit}", "tn": f"{label} = 0 AND NOT {hit}"}
    return [F.expr(f"if(count({threshold}) = 0, NULL, count_if({cell})) AS {name}") for name, cell in cells.items()]


def with_rates(df: DataFrame) -> DataFrame:
    """Rates from the four cells. Sensitivity and precision are 0 where undefined, the others null; all are null without cells."""
    rates = {
        "sensitivity": f"if(tp IS NULL, NULL, coalesce({ratio('tp', 'tp + fn')}, 0D))",
        "specificity": ratio("tn", "tn + fp"),
        "accuracy": ratio("tp + tn", "tp + fp + fn + tn"),
        "precision": f"if(tp IS NULL, NULL, coalesce({ratio('tp', 'tp + fp')}, 0D))",
        "npv": ratio("tn", "tn + fn"),
    }
    f1 = ratio("2 * precision * sensitivity", "precision + sensitivity")
    return df.withColumns({name: F.expr(text) for name, text in rates.items()}).withColumn("f1", F.expr(f1))


def confusion(scores: DataFrame, by: Sequence[str], threshold: str = "threshold") -> DataFrame:
    """Cells and rates per group at `p > threshold`."""
    return with_rates(
        scores.groupBy(*by).agg(*confusion_counts(threshold=threshold))
    )


def log_loss(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean negative log likelihood with clipped probabilities."""
    term = f"if(label = 1, {log_loss_term('p', True)}, {log_loss_term('p', False)})"
    scores = scores.where("p IS NOT NULL")
    return scores.groupBy(*by).agg(F.expr(f"avg({term}) AS logloss"), F.count("p").alias("n"))


def with_intervals(df: DataFrame, level: float = 0.95) -> DataFrame:
    """Wilson bounds of the five rates."""
    parts = {
        "sensitivity": ("tp", "tp + fn"),
        "specificity": ("tn", "tn + fp"),
        "accuracy": ("tp + tn", "tp + fp + fn + tn"),
        "precision": ("tp", "tp + fp"),
        "npv": ("tn", "tn + fn"),
    }
    bounds = {}
    for name, (hits, n) in parts.items():
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = wilson_bounds(hits, n, level)
    return df.withColumns(bounds)


def sens_spec_ci(scores: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Sensitivity and specificity with Wilson bounds."""
    kept = ["sensitivity", "sensitivity_lo", "sensitivity_hi", "specificity", "specificity_lo", "specificity_hi"]
    return with_intervals(confusion(scores, by), level).select(*by, *kept)


def formatted(df: DataFrame) -> DataFrame:
    """Text columns `<rate>_text` and `auc_text` for export."""
    texts = {f"{r}_text": format_percent_ci(F.col(r), F.col(f"{r}_lo"), F.col(f"{r}_hi")) for r in RATES}
    return df.withColumns({**texts, "auc_text": format_auc_ci(F.col("auc"), F.col("auc_lo"), F.col("auc_hi"))})


def evaluate_model(scores: DataFrame, thresholds: DataFrame, by: Sequence[str], on: Sequence[str] = ("site",), level: float = 0.95, splits: Sequence[float] | None = None) -> DataFrame:
    """The whole metric row per group from one ranked histogram; rows without a score are left out, as in `confusion`.

    `thresholds` has one row per value of the `on` columns, all of them part of `by`.
    """
    by = list(by)
    ranked = ranked_histogram(scores.where("p IS NOT NULL"), by, splits=splits)
    cut = lookup_join(ranked, thresholds.select(*on, "threshold"), list(on))
    loss = f"pos * {log_loss_term('p', True)} + neg * {log_loss_term('p', False)}"
    summed = cut.groupBy(*by).agg(
        F.max("threshold").alias("threshold"),
        # without a threshold neither side is counted, and the cells stay null
        F.expr("sum(if(threshold IS NULL, NULL, if(p > threshold, pos, 0))) AS tp"),
        F.expr("sum(if(threshold IS NULL, NULL, if(p > threshold, neg, 0))) AS fp"),
        F.expr("sum(if(threshold IS NULL, NULL, if(p > threshold, 0, pos))) AS fn"),
        F.expr("sum(if(threshold IS NULL, NULL, if(p > threshold, 0, neg))) AS tn"),
        *delong_aggregates(),
        F.expr(ratio(f"sum({loss})", "sum(pos + neg)") + " AS logloss"),
        F.expr("sum(pos + neg) AS n"),
    )
    low, high = auc_bounds(F.col("auc"), F.col("auc_var"), level)
    return with_intervals(with_rates(summed), level).withColumns({"auc_lo": low, "auc_hi": high})


def grid_value(i: str) -> str:
    """Threshold i of the 500 evenly spaced ones from 0 to 1."""
    return f"if({i} >= {GRID - 1}, 1D, double({i}) * {number(1.0 / (GRID - 1))})"


def thresholds_below(p: str) -> Column:
    """How many grid thresholds a score exceeds; the neighbours are compared, so `p > t` holds exactly."""
    guess = f"int(greatest(least(ceil({p} * {GRID - 1}), {GRID}), 0))"
    down = f"if({guess} > 0 AND {grid_value(f'({guess} - 1)')} >= {p}, {guess} - 1, {guess})"
    return F.expr(f"if(({down}) < {GRID} AND {grid_value(f'({down})')} < {p}, ({down}) + 1, {down})")


def threshold_sweep(scores: DataFrame, by: Sequence[str], prevalence: float = 1 / 11) -> DataFrame:
    """Metrics at the 500 grid thresholds, from one count per threshold cell.

    Precision and NPV are adjusted to the cohort's `prevalence`.
    """
    by = list(by)
    cells = scores.groupBy(*by, thresholds_below("p").alias("cell")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    # A score in cell c exceeds thresholds 0 .. c-1. Each occupied cell fills the thresholds up to the
    # next one; the first also those below it, where nothing is rejected yet.
    in_order = Window.partitionBy(*by).orderBy("cell")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = cells.select(
        *by,
        "cell",
        F.lag("cell").over(in_order).isNull().alias("lowest"),
        F.coalesce(F.lead("cell").over(in_order), F.lit(GRID + 1)).alias("following"),
        F.sum("pos").over(upto).alias("fn"),
        F.sum("neg").over(upto).alias("tn"),
        F.sum("pos").over(whole).alias("n_pos"),
        F.sum("neg").over(whole).alias("n_neg"),
    )
    spread = summed.withColumn("idx", F.expr("explode(sequence(if(lowest, 0, cell), following - 1))"))
    counted = spread.where(F.col("idx") < GRID).withColumns(
        {
            "threshold": F.expr(grid_value("idx")),
            "fn": F.expr("if(idx < cell, 0, fn)"),
            "tn": F.expr("if(idx < cell, 0, tn)"),
        }
    )
    prev, rest = number(prevalence), number(1 - prevalence)
    rates = counted.withColumns(
        {
            "recall": F.expr(f"coalesce({ratio('n_pos - fn', 'n_pos')}, 0D)"),
            "accuracy": F.expr(ratio("n_pos - fn + tn", "n_pos + n_neg")),
            "specificity": F.expr(ratio("tn", "n_neg")),
        }
    )
    ppv = ratio(f"recall * {prev}", f"recall * {prev} + (1 - specificity) * {rest}")
    npv = ratio(f"specificity * {rest}", f"specificity * {rest} + (1 - recall) * {prev}")
    rates = rates.withColumns({"precision": F.expr(ppv), "npv": F.expr(f"if(tn = 0 AND fn = 0, 0D, {npv})")})
    return rates.withColumn("f1", F.expr(ratio("2 * precision * recall", "precision + recall"))).select(
        *by, "idx", "threshold", "recall", "accuracy", "specificity", "precision", "npv", "f1"
    )


def best_threshold(sweep: DataFrame, by: Sequence[str], metric: str = "recall", target: float = 0.85, tolerance: float = 0.04) -> DataFrame:
    """The threshold whose metric lies strictly within the tolerance and whose companion is highest.

    Ties go to the smallest threshold; without any candidate the threshold is 0.
    """
    by = list(by)
    value, companion = F.col(metric), F.col(COMPANION[metric])
    fits = (value < target + tolerance) & (value > target - tolerance)
    order = F.when(fits, F.struct(F.coalesce(companion, F.lit(-1.0)).alias("c"), (-F.col("idx")).alias("i")))
    row = F.struct("threshold", "recall", "precision", "specificity", "accuracy", "npv", "f1")
    best = sweep.groupBy(*by).agg(F.max_by(F.when(fits, row), order).alias("best"))
    return best.select(
        *by,
        F.coalesce("best.threshold", F.lit(0.0)).alias("threshold"),
        *[F.col(f"best.{c}").alias(c) for c in ("recall", "precision", "specificity", "accuracy", "npv", "f1")],
        F.col("best").isNotNull().alias("found"),
    )


def calibrate(scores: DataFrame, by: Sequence[str], metric: str = "recall", target: float = 0.85, tolerance: float = 0.04, prevalence: float = 1 / 11) -> DataFrame:
    return best_threshold(threshold_sweep(scores, by, prevalence), by, metric, target, tolerance)


def mean_threshold(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the sites' thresholds; sites that only evaluate have none."""
    return thresholds.groupBy(*by).agg(F.avg("threshold").alias("threshold"))


def mcnemar_exact(predictions: DataFrame, by: Sequence[str], one: str = "pred1", two: str = "pred2", label: str = "label") -> DataFrame:
    """Agreement table of two classifiers and the exact p value of their discordant counts."""
    right1, right2 = F.col(one) == F.col(label), F.col(two) == F.col(label)
    table = predictions.groupBy(*by).agg(
        F.count_if(right1 & right2).alias("both_right"),
        F.count_if(right1 & ~right2).alias("only_one_right"),
        F.count_if(~right1 & right2).alias("only_two_right"),
        F.count_if(~right1 & ~right2).alias("both_wrong"),
    )
    return table.withColumn("p_value", exact_sign_p(F.col("only_one_right"), F.col("only_two_right")))
