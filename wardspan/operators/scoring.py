"""Model scores as column expressions over a bounded number of parameter vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.functions.stats import logistic, number
from wardspan.operators.params import lr_size, mlp_forward, mlp_size, unpack
from wardspan.operators.scale import local_table, lookup_join, pin_small

INLINE_TERMS = 128


def quoted(features: Sequence[str]) -> list[str]:
    return [f"`{f}`" for f in features]


def weight_terms(n: int, w: Sequence[float] | None = None) -> list[str]:
    """SQL text of n weights: literals of a given vector, else the entries of column `w`."""
    return [f"element_at(w, {i})" for i in range(1, n + 1)] if w is None else [f"({number(v)})" for v in w]


def linear_term(features: Sequence[str], w: Sequence[float] | None = None) -> str:
    """w . x + b as SQL text, for a flat vector `[w1..wp, b]`.

    Long sums are built as text: one parsed expression instead of a call into the JVM per term.
    """
    return _weighted_sum(features, weight_terms(lr_size(len(features)), w))


def _weighted_sum(features: Sequence[str], weights: Sequence[str]) -> str:
    products = [f"{v} * {f}" for v, f in zip(weights, quoted(features), strict=False)]
    return " + ".join([weights[len(features)], *products])


def mlp_term(features: Sequence[str], hidden: int, w: Sequence[float] | None = None) -> str:
    """Output of one ReLU layer before the sigmoid, as SQL text.

    The flat vector holds, per hidden unit, its input weights and bias, then the output weights and
    bias. Dropout is inactive at scoring.
    """
    size = len(features) + 1
    weights = weight_terms(mlp_size(len(features), hidden), w)
    units = [_weighted_sum(features, weights[h * size : (h + 1) * size]) for h in range(hidden)]
    last = weights[hidden * size :]
    return " + ".join([last[-1], *[f"{v} * greatest({u}, 0D)" for v, u in zip(last, units, strict=False)]])


def model_score(model: str, features: Sequence[str], hidden: int = 10, w: Sequence[float] | None = None) -> Column:
    return F.expr(logistic(linear_term(features, w) if model == "LR" else mlp_term(features, hidden, w)))


def only_vector(params: DataFrame) -> Sequence[float]:
    """The weights of a table that must hold one row."""
    rows = params.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one parameter row is needed without key columns, there are {'several' if rows else 'none'}")
    return rows[0]["w"]


def _mlp_in_batches(df: DataFrame, params: DataFrame, features: Sequence[str], on: list[str], hidden: int) -> DataFrame:
    """Matrix products on Arrow batches; every task gets the checked, small set of weight vectors."""
    if not on:
        one = unpack(np.asarray(only_vector(params), dtype="float64"), len(features), hidden)

        @F.pandas_udf(T.DoubleType())
        def forward_one(x: pd.DataFrame) -> pd.Series:
            return pd.Series(mlp_forward(x.to_numpy("float64"), one)[1])

        return df.withColumn("p", forward_one(F.struct(*features)))
    pinned, fits = pin_small(params)
    if not fits:
        joined = lookup_join(df, pinned, on, "inner")
        return joined.withColumn("p", model_score("NN", features, hidden)).drop("w")
    rows = pinned.collect()
    weights = [unpack(np.asarray(r["w"], dtype="float64"), len(features), hidden) for r in rows]
    positions = local_table(
        df.sparkSession,
        [{**{c: r[c] for c in on}, "_row": i} for i, r in enumerate(rows)],
        ", ".join([*[f"`{c}` {pinned.schema[c].dataType.simpleString()}" for c in on], "_row int"]),
    )

    @F.pandas_udf(T.DoubleType())
    def forward(row: pd.Series, x: pd.DataFrame) -> pd.Series:
        inputs, which = x.to_numpy("float64"), row.to_numpy()
        p = np.empty(len(row))
        for i in np.unique(which):
            picked = which == i
            p[picked] = mlp_forward(inputs[picked], weights[i])[1]
        return pd.Series(p)

    joined = df.join(F.broadcast(positions), on)
    return joined.withColumn("p", forward(F.col("_row"), F.struct(*features))).drop("_row")


def score_rows(df: DataFrame, params: DataFrame, model: str, features: Sequence[str], on: Sequence[str] = (), hidden: int = 10, name: str = "p") -> DataFrame:
    """Add a score, using the parameter row with the same `on` columns (one row for all without them).

    Wide networks are scored on Arrow batches, because their unrolled expression would outgrow what the
    JVM compiles.
    """
    params = params.select(*on, "w")
    in_batches = model != "LR" and len(features) * hidden > INLINE_TERMS
    if not on and not in_batches:
        scored = df.withColumn("p", model_score(model, features, hidden, only_vector(params)))
    elif in_batches:
        scored = _mlp_in_batches(df, params, features, list(on), hidden)
    else:
        joined = lookup_join(df, params, list(on), "inner")
        scored = joined.withColumn("p", model_score(model, features, hidden)).drop("w")
    return scored.withColumnRenamed("p", name)


def threshold_label(p: Column, threshold: Column) -> Column:
    return (p > threshold).cast("int")
