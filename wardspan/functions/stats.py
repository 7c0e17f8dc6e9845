"""Closed-form statistics as column expressions; normal tails through Arrow on result rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_LOSS_FLOOR = 2.220446049250313e-16


def normal_quantile(level: float = 0.95) -> float:
    """Two-sided standard normal quantile of a confidence level."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def number(value: float) -> str:
    """A double literal in SQL text."""
    return f"{float(value)!r}D"


def ratio(top: str, bottom: str) -> str:
    """Double division that gives null for an empty denominator."""
    return f"try_divide(double({top}), double({bottom}))"


def wilson_bounds(hits: str, n: str, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of `hits` out of `n`, both SQL expressions; null when `n` is 0."""
    z = number(normal_quantile(level))
    share, n = ratio(hits, n), f"nullif(double({n}), 0D)"
    centre = f"{share} + {z} * {z} / (2 * {n})"
    spread = f"{z} * sqrt({share} * (1 - {share}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    shrink = f"(1 + {z} * {z} / {n})"
    return F.expr(f"({centre} - {spread}) / {shrink}"), F.expr(f"({centre} + {spread}) / {shrink}")


def logistic(z: str) -> str:
    return f"1D / (1D + exp(-({z})))"


def log_loss_term(p: str, positive: bool) -> str:
    likelihood = p if positive else f"1D - {p}"
    return f"-ln(least(greatest({likelihood}, {number(LOG_LOSS_FLOOR)}), {number(1.0 - LOG_LOSS_FLOOR)}))"


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p value of each statistic."""
    return z.map(lambda v: math.erfc(v / math.sqrt(2.0)), na_action="ignore").astype("float64")


def _binomial_half_tail(low: int, n: int) -> float:
    """P(X <= low) for X ~ Binomial(n, 1/2), summed downwards until the terms vanish."""
    total, upper, step = 0.0, low, 65_536
    base = math.lgamma(n + 1) - n * math.log(2.0)
    while upper >= 0:
        ks = np.arange(upper, max(upper - step, -1), -1, dtype=np.int64)
        # ratio of neighbouring terms C(n, k-1) / C(n, k) = k / (n - k + 1)
        first = math.exp(base - math.lgamma(upper + 1) - math.lgamma(n - upper + 1))
        terms = first * np.concatenate(([1.0], np.cumprod(ks[:-1] / (n - ks[:-1] + 1.0))))
        total += float(terms.sum())
        if terms[-1] <= total * 1e-18:
            break
        upper -= step
    return total


@F.pandas_udf(T.DoubleType())
def exact_sign_p(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact two-sided binomial p value of two discordant counts."""
    return pd.Series(
        [
            min(1.0, 2.0 * _binomial_half_tail(int(min(a, b)), int(a + b))) if a + b else 1.0
            for a, b in zip(left, right, strict=True)
        ],
        dtype="float64",
    )
