"""Model parameters as flat vectors, and their federated averages.

LR: `[w1..wp, b]`. NN: per hidden unit its input weights and bias, then the output weights and bias.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.functions.stats import ratio
from wardspan.operators.scale import local_table

PARAMS_SCHEMA = "model string, site string, round int, n_train bigint, w array<double>"
GLOBAL = "GLOBAL"


def lr_size(n_features: int) -> int:
    return n_features + 1


def mlp_size(n_features: int, hidden: int) -> int:
    return hidden * (n_features + 1) + hidden + 1


def unpack(w: np.ndarray, n_features: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Flat vector -> input weights, hidden biases, output weights, output bias."""
    first = w[: hidden * (n_features + 1)].reshape(hidden, n_features + 1)
    last = w[hidden * (n_features + 1) :]
    return first[:, :-1].T.copy(), first[:, -1].copy(), last[:-1].copy(), float(last[-1])


def pack(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> np.ndarray:
    return np.concatenate([np.column_stack([w1.T, b1]).ravel(), w2, [b2]])


def mlp_forward(x: np.ndarray, weights) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations and output probabilities."""
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0.0)
    return hidden, 1.0 / (1.0 + np.exp(-(hidden @ w2 + b2)))


def glorot_weights(n_features: int, hidden: int, seed: int = 20) -> np.ndarray:
    """Seeded uniform starting weights with zero biases."""
    rng = np.random.default_rng(seed)
    wide, narrow = np.sqrt(6.0 / (n_features + hidden)), np.sqrt(6.0 / (hidden + 1))
    w1 = rng.uniform(-wide, wide, (n_features, hidden))
    return pack(w1, np.zeros(hidden), rng.uniform(-narrow, narrow, hidden), 0.0)


def init_params(sites: DataFrame, n_features: int) -> DataFrame:
    """Zero LR parameters for every site, round 0."""
    return sites.select("site").distinct().select(
        F.lit("LR").alias("model"),
        "site",
        F.lit(0).alias("round"),
        F.lit(0).cast("long").alias("n_train"),
        F.array_repeat(F.lit(0.0), lr_size(n_features)).alias("w"),
    )


def params_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    return local_table(spark, rows, PARAMS_SCHEMA)


def fedavg_params(params: DataFrame, by: Sequence[str] = ("model", "round")) -> DataFrame:
    """Average of every coordinate, weighted by training rows: `(by, idx, value)`."""
    return (
        params.select(*by, "n_train", F.posexplode("w").alias("idx", "v"))
        .groupBy(*by, "idx")
        .agg(F.expr(ratio("sum(v * n_train)", "sum(n_train)")).alias("value"), F.sum("n_train").alias("n_train"))
    )


def fedavg_vectors(params: DataFrame, by: Sequence[str] = ("model", "round")) -> DataFrame:
    """The averaged parameters as one `GLOBAL` vector per group; a vector has a few hundred numbers."""
    averaged = fedavg_params(params, by)
    vectors = averaged.groupBy(*by).agg(
        F.max("n_train").alias("n_train"), F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")
    )
    return vectors.select(*by, F.lit(GLOBAL).alias("site"), "n_train", F.col("v.value").alias("w"))


def fedavg_loss(losses: DataFrame, by: Sequence[str] = ("model", "round")) -> DataFrame:
    """Validation loss averaged by validation rows."""
    return losses.groupBy(*by).agg(
        F.expr(ratio("sum(logloss * n)", "sum(n)")).alias("logloss"), F.sum("n").alias("n")
    )


def weighted_mean(rows: Sequence) -> list[float]:
    """The same average for the few parameter rows of one round that the driver already holds."""
    n = np.array([row["n_train"] for row in rows], dtype="float64")
    return (np.array([row["w"] for row in rows]).T @ n / n.sum()).tolist()
