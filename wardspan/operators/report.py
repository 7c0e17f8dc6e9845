"""Round histories, wide tables and summaries from the long result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspan.functions.text import parse_ci
from wardspan.operators.scale import lookup_join

SUMMARY_METRICS = ["auc", "sensitivity", "specificity", "accuracy", "precision", "npv", "f1"]
TABLE_METRICS = [*SUMMARY_METRICS, "fn", "fp", "p_vs_round1", "p_lr_vs_nn"]
MODEL_ORDER = ["LR", "NN"]
STAGE_ORDER = ["local", "global", "personalised"]


def round_index(results: DataFrame, by: Sequence[str] = ("site", "model", "variant", "split")) -> DataFrame:
    """0-based position of each round inside its series."""
    return results.withColumn("round_index", F.row_number().over(Window.partitionBy(*by).orderBy("round")) - 1)


def continue_rounds(results: DataFrame, lr_rounds: int) -> DataFrame:
    """NN rows go on counting after the LR rounds."""
    shifted = F.when(F.col("model") == "NN", F.col("round") + lr_rounds).otherwise(F.col("round"))
    return results.withColumn("iteration", shifted)


def round_history(parts: Sequence[DataFrame]) -> DataFrame:
    """All streams of all rounds in one table. A site that only evaluates has no rows in the other streams."""
    history = parts[0]
    for part in parts[1:]:
        history = history.unionByName(part, allowMissingColumns=True)
    return history


def first_last_round(results: DataFrame, by: Sequence[str] = ("site", "model", "variant")) -> DataFrame:
    """First and last round of every series, in the columns `first_*` and `last_*`."""
    row = F.struct("round", *SUMMARY_METRICS)
    ends = results.groupBy(*by).agg(F.min_by(row, "round").alias("a"), F.max_by(row, "round").alias("z"))
    names = ["round", *SUMMARY_METRICS]
    return ends.select(*by, *[F.col(f"a.{n}").alias(f"first_{n}") for n in names], *[F.col(f"z.{n}").alias(f"last_{n}") for n in names])


def results_by_site(results: DataFrame, sites: Sequence[str], metrics: Sequence[str] = TABLE_METRICS) -> DataFrame:
    """One row per model and round index, one column per site and metric."""
    indexed = round_index(results, ("site", "model"))
    picked = [F.first(m, ignorenulls=True).alias(m) for m in metrics]
    return indexed.groupBy("model", "round_index").pivot("site", list(sites)).agg(*picked)


def roc_by_site(roc: DataFrame, sites: Sequence[str]) -> DataFrame:
    """One row per model and point, TPR and FPR of every site side by side."""
    return (
        roc.groupBy("model", "idx")
        .pivot("site", list(sites))
        .agg(F.first("tpr").alias("tpr"), F.first("fpr").alias("fpr"))
    )


def _position(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


def summary_table(results: DataFrame, external_sites: Sequence[str] = ()) -> DataFrame:
    """Local, global and personalised models side by side, with F1 to three digits.

    The local model is the first round of the global series, which sites that only evaluate do not have;
    the others are last rounds. Combinations without rows are absent.
    """
    ends = first_last_round(results)
    is_global = F.col("variant") == "global"

    def pick(rows: DataFrame, end: str, stage: str) -> DataFrame:
        return rows.select("site", "model", F.lit(stage).alias("stage"), *[F.col(f"{end}_{m}").alias(m) for m in SUMMARY_METRICS])

    parts = [
        pick(ends.where(is_global & ~F.col("site").isin(list(external_sites))), "first", "local"),
        pick(ends.where(is_global), "last", "global"),
        pick(ends.where(F.col("variant") == "personalised"), "last", "personalised"),
    ]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("f1", F.round("f1", 3))
    label = F.concat_ws(" ", "site", "model", "stage")
    order = (_position("model", MODEL_ORDER) - 1) * len(STAGE_ORDER) + _position("stage", STAGE_ORDER)
    return table.select(label.alias("name"), "site", order.cast("int").alias("position"), *SUMMARY_METRICS)


def align_rounds(spine: DataFrame, others: Sequence[DataFrame], on: Sequence[str] = ("site", "round_index")) -> DataFrame:
    """Left join result tables to the rounds of the first one."""
    for other in others:
        spine = spine.join(other, list(on), "left")
    return spine



def federation_curves(results: DataFrame, models: Sequence[str] = MODEL_ORDER, variants: Sequence[str] = ("global", "personalised")) -> DataFrame:
    """AUC with bounds by site and round index, one column group per model and variant.

    The rounds of the NN global series are the rows, as in the published curves.
    """
    indexed = round_index(results, ("site", "model", "variant"))
    values = ["auc", "auc_lo", "auc_hi"]

    def series(model: str, variant: str) -> DataFrame:
        rows = indexed.where((F.col("model") == model) & (F.col("variant") == variant))
        names = [F.col(v).alias(f"{model.lower()}_{variant}_{v}") for v in values]
        return rows.select("site", "round_index", *names)

    spine = indexed.where((F.col("model") == models[-1]) & (F.col("variant") == variants[0])).select("site", "round_index")
    return align_rounds(spine, [series(m, v) for m in models for v in variants])


def roc_compare(roc: DataFrame) -> DataFrame:
    """The curves of the first and the last round per site and model."""
    ends = roc.groupBy("site", "model").agg(F.min("round").alias("first"), F.max("round").alias("last"))
    stage = F.when(F.col("round") == F.col("first"), "first_round").otherwise("last_round")
    return (
        lookup_join(roc, ends, ["site", "model"], "inner")
        .where((F.col("round") == F.col("first")) | (F.col("round") == F.col("last")))
        .select("site", "model", stage.alias("stage"), "idx", "threshold", "fpr", "tpr")
    )


def central_eval_table(results: DataFrame, lr_rounds: int) -> DataFrame:
    """Server-side evaluation rows by running iteration."""
    central = results.where(F.col("split") == "central")
    return continue_rounds(central, lr_rounds).select(
        "iteration", "site", "model", "sensitivity", "specificity", "accuracy", "auc", "precision", "npv", "fn", "fp", "f1"
    )
