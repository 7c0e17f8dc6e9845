"""Local training of the small neural network inside bounded groups of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardspan.operators.params import PARAMS_SCHEMA, mlp_forward, pack, unpack
from wardspan.operators.scale import lookup_join

SHARD_SCHEMA = "site string, round int, shard int, n_train bigint, epochs int, val_auc double, w array<double>"
CLIP = 1e-7


def rank_auc(p: np.ndarray, y: np.ndarray) -> float:
    pos, neg = np.sort(p[y == 1]), np.sort(p[y == 0])
    if not len(pos) or not len(neg):
        return float("nan")
    wins = np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()
    return wins / (2.0 * len(pos) * len(neg))


def mlp_gradient_mean(x: np.ndarray, y: np.ndarray, w: np.ndarray, hidden: int) -> np.ndarray:
    """Gradient of the mean cross-entropy of one batch."""
    weights = unpack(w, x.shape[1], hidden)
    h, p = mlp_forward(x, weights)
    error = (p - y) / len(y)
    back = np.outer(error, weights[2]) * (h > 0)
    return pack(x.T @ back, back.sum(axis=0), h.T @ error, float(error.sum()))


def train_mlp(x, y, x_val, y_val, w, hidden=10, epochs=50, patience=15, batch=4096, rate=0.001, seed=20):
    """Adam on shuffled batches; returns the weights of the best validation AUC, that AUC and the epochs run."""
    rng = np.random.default_rng(seed)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    best, best_auc, since, epoch = w.copy(), -np.inf, 0, 0
    for epoch in range(1, epochs + 1):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            g = mlp_gradient_mean(x[rows], y[rows], w, hidden)
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + CLIP)
        auc = rank_auc(mlp_forward(x_val, unpack(w, x.shape[1], hidden))[1], y_val)
        if np.isnan(auc) or auc > best_auc:
            best, best_auc, since = w.copy(), auc if not np.isnan(auc) else best_auc, 0
        else:
            since += 1
            if since >= patience:
                break
    return best, (best_auc if np.isfinite(best_auc) else None), epoch


def mlp_shard_fit(
    prepared: DataFrame,
    start: Mapping[tuple[str, int], Sequence[float]],
    features: Sequence[str],
    hidden: int = 10,
    epochs: int = 50,
    patience: int = 15,
    batch: int = 4096,
    rows_per_shard: int = 20_000,
    seed: int = 20,
    key: str = "encounter_id",
) -> DataFrame:
    """One network per start vector and shard, trained on the shard's `train` rows and judged on its
    `test` rows. Start vectors are keyed by site and round; the rounds of a site share its shards.

    Every site is cut by a hash of the ids into shards of about `rows_per_shard` training rows, which train in
    parallel and are averaged: the same rule at every size, and no task holds more than a shard.
    """
    features = list(features)
    weights = {key: np.asarray(w, dtype="float64") for key, w in start.items()}
    used = prepared.where(F.col("split").isin("train", "test"))
    shards = F.greatest(F.ceil(F.count_if(F.col("split") == "train") / rows_per_shard), F.lit(1)).cast("int")
    sizes = used.groupBy("site").agg(shards.alias("n_shards"))
    sharded = (
        lookup_join(used, sizes, ["site"])
        .withColumn("shard", F.pmod(F.xxhash64(key, F.lit(seed)), F.col("n_shards")).cast("int"))
        .select("site", "shard", "split", "label", key, *[F.col(f).cast("double") for f in features])
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        site, shard = str(group["site"].iloc[0]), int(group["shard"].iloc[0])
        fitting = (group["split"] == "train").to_numpy()
        x, y = group[features].to_numpy("float64"), group["label"].to_numpy("float64")
        rows = []
        for (name, round_no), w in weights.items():
            if name == site and fitting.any():
                w, auc, ran = train_mlp(
                    x[fitting], y[fitting], x[~fitting], y[~fitting], w, hidden, epochs, patience, batch,
                    seed=seed + shard,
                )
                rows.append((site, round_no, shard, int(fitting.sum()), ran, auc, w))
        return pd.DataFrame(rows, columns=["site", "round", "shard", "n_train", "epochs", "val_auc", "w"])

    return sharded.groupBy("site", "shard").applyInPandas(fit, SHARD_SCHEMA)


def mlp_local_fit(prepared: DataFrame, start: Mapping[tuple[str, int], Sequence[float]], features: Sequence[str], **options) -> DataFrame:
    """Parameters per site and round; the shards of a large site are averaged by their training rows."""
    shards = mlp_shard_fit(prepared, start, features, **options)
    averaged = (
        shards.select("site", "round", "n_train", F.posexplode("w").alias("idx", "v"))
        .groupBy("site", "round", "idx")
        .agg((F.sum(F.col("v") * F.col("n_train")) / F.sum("n_train")).alias("v"), F.sum("n_train").alias("n_train"))
    )
    vectors = averaged.groupBy("site", "round").agg(
        F.max("n_train").alias("n_train"), F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("packed")
    )
    columns = [F.lit("NN").alias("model"), "site", "round", "n_train", F.col("packed.v").alias("w")]
    return vectors.select(*columns).to(StructType.fromDDL(PARAMS_SCHEMA))
