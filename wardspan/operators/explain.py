"""Attributions: sampled Shapley values over a small background, the linear closed form, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspan.operators.params import unpack
from wardspan.operators.prepare import sample_rows
from wardspan.operators.scale import lookup_join

BLOCK_NUMBERS = 2_000_000
MOST_EXACT = 14


def _explained(background: DataFrame, w: Sequence[float], model: str, features: Sequence[str], hidden: int, n_background: int, seed: int, key: str) -> tuple:
    """The background sample, and the model as first layer and output (no output for LR)."""
    base = sample_rows(background, n_background, key, seed).select(*features).toPandas().to_numpy("float64")
    flat, p = np.asarray(w, dtype="float64"), len(features)
    return base, *((flat[:p, None], flat[p : p + 1], None, None) if model == "LR" else unpack(flat, p, hidden))


def _mean_prediction(out: np.ndarray | None, last: float | None) -> Callable[[np.ndarray], np.ndarray]:
    """Mean over the background of the output for a first layer (rows x background x units)."""
    if out is None:
        return lambda layer: (layer[..., 0] > 0).mean(axis=1)
    return lambda layer: (1 / (1 + np.exp(-np.clip(np.maximum(layer, 0) @ out + last, -700, 700)))).mean(axis=1)


def _attributed(rows: DataFrame, explain: Callable[[np.ndarray], np.ndarray], model: str, features: Sequence[str], key: str, numbers: int) -> DataFrame:
    """`(key, model, feature, phi)` from `explain` on blocks of rows; a row takes about so many `numbers` of memory."""

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = max(1, BLOCK_NUMBERS // max(1, numbers))
        for batch in batches:
            values = batch[features].to_numpy("float64")
            phis = [phi for k in range(0, len(values), block) for phi in explain(values[k : k + block])]
            yield pd.DataFrame({key: batch[key], "phi": phis})

    kind = rows.schema[key].dataType.simpleString()
    packed = rows.select(key, *features).mapInPandas(attribute, f"{key} {kind}, phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    return packed.select(
        key, F.lit(model).alias("model"), F.posexplode(F.arrays_zip(names.alias("feature"), F.col("phi"))).alias("i", "v")
    ).select(key, "model", F.col("v.feature").alias("feature"), F.col("v.phi").alias("phi"))


def shapley_exact(
    rows: DataFrame,
    background: DataFrame,
    w: Sequence[float],
    model: str,
    features: Sequence[str],
    hidden: int = 10,
    n_background: int = 100,
    seed: int = 42,
    key: str = "encounter_id",
) -> DataFrame:
    """Exact Shapley values `(key, model, feature, phi)` of every given row, for at most MOST_EXACT features.

    The values `shapley_sampled` estimates, from all 2^p coalitions: they are visited in Gray-code order, so that from one
    to the next a single feature is switched in the first layer. The mean predictions of a row's coalitions are weighted
    into its values as they come, so a row needs no more memory for more features.
    """
    features, p = list(features), len(features)
    if p > MOST_EXACT:
        raise ValueError(f"{p} features have 2^{p} coalitions; use shapley_sampled beyond {MOST_EXACT}")
    base, into, shift, out, last = _explained(background, w, model, features, hidden, n_background, seed, key)
    mean_prediction = _mean_prediction(out, last)
    # what a coalition of s features counts for a member (joined by it) and for the others (to be joined)
    member = [factorial(s - 1) * factorial(p - s) / factorial(p) if s else 0.0 for s in range(p + 1)]
    other = [factorial(s) * factorial(p - s - 1) / factorial(p) if s < p else 0.0 for s in range(p + 1)]

    def explain(x: np.ndarray) -> np.ndarray:
        phi = np.zeros_like(x)
        inside = np.zeros(p, bool)
        layer = np.repeat((base @ into + shift)[None], len(x), axis=0)
        for step in range(1 << p):
            if step:
                feature = (step & -step).bit_length() - 1
                inside[feature] ^= True
                change = (x[:, feature, None] - base[None, :, feature])[..., None] * into[feature]
                layer += change if inside[feature] else -change
            size = int(inside.sum())
            phi += mean_prediction(layer)[:, None] * np.where(inside, member[size], -other[size])
        return phi

    return _attributed(rows, explain, model, features, key, len(base) * into.shape[1])


def shapley_sampled(
    rows: DataFrame,
    background: DataFrame,
    w: Sequence[float],
    model: str,
    features: Sequence[str],
    hidden: int = 10,
    n_background: int = 100,
    permutations: int = 10,
    seed: int = 42,
    key: str = "encounter_id",
) -> DataFrame:
    """Permutation Shapley values `(encounter_id, model, feature, phi)` of every given row.

    LR is explained on its 0/1 prediction, the network on its probability. Features are switched on in
    `permutations` seeded orders, each also run backwards, against `n_background` background rows, which have to fit a
    worker's memory; the values of a row add up to its prediction less the mean prediction over the background. A switch
    only adds to the first layer, so a block of rows is taken through an order at once.
    """
    features, p = list(features), len(features)
    base, into, shift, out, last = _explained(background, w, model, features, hidden, n_background, seed, key)
    rng = np.random.default_rng(seed)
    orders = [path for order in (rng.permutation(p) for _ in range(permutations)) for path in (order, order[::-1])]

    mean_prediction = _mean_prediction(out, last)

    def explain(x: np.ndarray) -> np.ndarray:
        phi = np.zeros_like(x)
        for path in orders:
            layer = np.repeat((base @ into + shift)[None], len(x), axis=0)
            before = mean_prediction(layer)
            for feature in path:
                layer += (x[:, feature, None] - base[None, :, feature])[..., None] * into[feature]
                after = mean_prediction(layer)
                phi[:, feature] += after - before
                before = after
        return phi / max(1, len(orders))

    return _attributed(rows, explain, model, features, key, len(base) * into.shape[1])


def shapley_linear(rows: DataFrame, background: DataFrame, params: DataFrame, features: Sequence[str], by: str = "site", key: str = "encounter_id") -> DataFrame:
    """`w_j * (x_j - mean_j)` with the means of the site's background rows."""
    means = background.groupBy(by).agg(*[F.avg(f).alias(f"_mean_{f}") for f in features])
    joined = lookup_join(lookup_join(rows, means, [by], "inner"), params.select(by, "w"), [by], "inner")
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.element_at("w", i) * (F.col(f) - F.col(f"_mean_{f}"))).alias("phi"))
        for i, f in enumerate(features, start=1)
    ]
    return joined.select(key, by, F.inline(F.array(*parts)))


def shap_summary(attributions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean absolute attribution per feature and its rank, ties in name order."""
    means = attributions.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    order = Window.partitionBy(*by).orderBy(F.desc("mean_abs_phi"), "feature")
    return means.withColumn("rank", F.row_number().over(order))


def feature_importance(params: DataFrame, features: Sequence[str], top: int = 40) -> DataFrame:
    """The largest absolute coefficients of a linear model, intercept left out."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.arrays_zip(names.alias("feature"), F.slice("w", 1, len(features)).alias("coefficient"))
    return (
        params.select(F.inline(pairs))
        .select("feature", F.abs("coefficient").alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )
