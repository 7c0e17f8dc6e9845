"""Per-site logistic regression: gradients as Spark aggregates, the optimiser's few numbers on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.stats import number
from wardspan.operators.params import params_table
from wardspan.operators.scale import local_table, lookup_join
from wardspan.operators.scoring import linear_term, quoted

ARMIJO = 1e-4
HISTORY = 10
#: Shorter strides of a Newton step whose losses are summed in the same job as the full step.
SHORTER = (0.5, 0.25, 0.0625, 0.015625)

#: Start vector by site and round.
Key = tuple[str, int]


def lr_gradient(df: DataFrame, params: DataFrame, features: Sequence[str], c: float = 1.0, by: Sequence[str] = ("site",)) -> DataFrame:
    """Loss and gradient of `|w|^2 / 2 + C * sum of log losses`; the intercept is not penalised.

    `by` names the key of a parameter row, `site` first. A site may have several rows, such as one per
    round: each of its encounters then counts once for every one of them, in the same pass. Sums are
    combined inside every task, so one row per key and task is shuffled.
    """
    by, p = list(by), len(features)
    params = params.select(*by, "w")
    joined = lookup_join(df.select("site", "label", *features), params, ["site"], "inner")
    scored = joined.select(*by, "label", *features, F.expr(linear_term(features)).alias("_z"))
    row_loss = "greatest(_z, 0D) - label * _z + log1p(exp(-abs(_z)))"
    error = "1D / (1D + exp(-_z)) - label"
    summed = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.expr(f"sum({row_loss}) AS _loss"),
        *[F.expr(f"sum(({error}) * {f}) AS _g{i}") for i, f in enumerate(quoted(features))],
        F.expr(f"sum({error}) AS _g{p}"),
    )
    penalty = f"aggregate(slice(w, 1, {p}), 0D, (total, v) -> total + v * v) / 2"
    gradient = [f"{number(c)} * _g{i} + element_at(w, {i + 1})" for i in range(p)] + [f"{number(c)} * _g{p}"]
    return lookup_join(summed, params, by, "inner").selectExpr(
        *by, "n", f"{number(c)} * _loss + {penalty} AS loss", f"array({', '.join(gradient)}) AS gradient"
    )


class _Descent:
    """Limited-memory quasi-Newton steps of one site; it never sees rows, only losses and gradients."""

    def __init__(self, w: np.ndarray):
        self.w, self.loss, self.gradient, self.n = w, None, None, 0
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.stride, self.tries, self.done = None, 1.0, 0, False

    def aim(self) -> None:
        g = self.gradient.copy()
        pending = []
        for s, y in reversed(self.steps):
            a = (s @ g) / (y @ s)
            g -= a * y
            pending.append((a, s, y))
        if self.steps:
            s, y = self.steps[-1]
            g *= (s @ y) / (y @ y)
        for a, s, y in reversed(pending):
            g += s * (a - (y @ g) / (y @ s))
        self.direction = -g
        if self.direction @ self.gradient >= 0:
            self.steps, self.direction = [], -self.gradient
        self.stride = 1.0 if self.steps else min(1.0, 1.0 / max(np.abs(self.gradient).sum(), 1e-300))
        self.tries = 0

    @property
    def trial(self) -> np.ndarray:
        return self.w + self.stride * self.direction

    def take(self, loss: float, gradient: np.ndarray) -> bool:
        """Accept the trial point, or shorten the step by the minimum of the parabola through it."""
        slope = self.direction @ self.gradient
        if loss <= self.loss + ARMIJO * self.stride * slope:
            s, y = self.stride * self.direction, gradient - self.gradient
            if s @ y > 1e-10 * (y @ y) ** 0.5 * (s @ s) ** 0.5:
                self.steps = [*self.steps, (s, y)][-HISTORY:]
            self.w, self.loss, self.gradient = self.trial, loss, gradient
            return True
        bend = 2 * (loss - self.loss - self.stride * slope)
        best = -slope * self.stride**2 / bend if bend > 0 else self.stride / 2
        self.stride = float(np.clip(best, self.stride / 10, self.stride / 2))
        self.tries += 1
        self.done = self.tries > 30
        return False


def lr_local_fit(
    train: DataFrame,
    start: Mapping[tuple[str, int], Sequence[float]],
    features: Sequence[str],
    iterations: int = 5,
    c: float = 1.0,
    tolerance: float = 1e-6,
) -> DataFrame:
    """A few solver iterations from each start vector, keyed by site and round.

    Every evaluation is one Spark job that serves all sites and rounds; those that still search along
    their line and those that start a new step share it. Callers keep `train` persisted.
    """
    spark = train.sparkSession

    def evaluate(points: Mapping[Key, np.ndarray]) -> dict[Key, tuple[float, np.ndarray, int]]:
        rows = [{"site": s, "round": r, "w": w.tolist()} for (s, r), w in points.items()]
        table = local_table(spark, rows, "site string, round int, w array<double>")
        found = lr_gradient(train, table, features, c, ("site", "round")).collect()
        return {(r["site"], r["round"]): (r["loss"], np.asarray(r["gradient"]), r["n"]) for r in found}

    descents = {key: _Descent(np.asarray(w, dtype="float64")) for key, w in start.items()}
    for key, (loss, gradient, n) in evaluate({k: d.w for k, d in descents.items()}).items():
        descents[key].loss, descents[key].gradient, descents[key].n = loss, gradient, n
    active = {k: d for k, d in descents.items() if d.n > 0}
    finished = dict.fromkeys(active, 0)
    for d in active.values():
        d.aim()
    while active:
        outcome = evaluate({k: d.trial for k, d in active.items()})
        for key in list(active):
            d = active[key]
            loss, gradient, _ = outcome[key]
            if d.take(loss, gradient):
                finished[key] += 1
                d.done = finished[key] >= iterations or np.abs(d.gradient).max() <= tolerance * max(1.0, c * d.n)
                if not d.done:
                    d.aim()
            if d.done:
                del active[key]
    return params_table(
        spark,
        [
            {"model": "LR", "site": s, "round": r, "n_train": int(d.n), "w": d.w.tolist()}
            for (s, r), d in descents.items()
            if d.n > 0
        ],
    )


def lr_curvature(
    df: DataFrame,
    points: Mapping[Key, Sequence[float]],
    features: Sequence[str],
    c: float = 1.0,
    others: Mapping[Key, Sequence[Sequence[float]]] | None = None,
) -> DataFrame:
    """Loss, gradient and Hessian of the regression's objective (see `lr_gradient`) at one point per site and round.

    Returns `(site, round, n, loss, gradient, hessian, losses)`: `hessian` is the upper triangle by rows, `losses` the
    loss at each of the `others` of that key, as many for every key. All come from one pass: a task sums matrix products
    over its Arrow batches and emits its sums once, so the shuffle holds one vector per key and task and is combined
    number by number. Rows need a label and whole features, as `prepare` leaves them; rows of sites without a point are
    skipped, points of sites without rows get none.
    """
    features, p = list(features), len(features)
    others = others or {}
    by_site: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for (site, round_no), w in points.items():
        trials = np.asarray([w, *others.get((site, round_no), [])], dtype="float64")
        by_site.setdefault(site, []).append((round_no, trials[0], trials))
    extra = max((len(t) for _, ts in by_site.items() for *_, t in ts), default=1) - 1
    upper = np.triu_indices(p + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[Key, np.ndarray] = {}
        for batch in batches:
            for site, rows in batch.groupby("site"):
                x = np.column_stack([rows[features].to_numpy("float64"), np.ones(len(rows))])
                y = rows["label"].to_numpy("float64")
                for round_no, w, trials in by_site[site]:
                    z = x @ trials.T
                    losses = (np.maximum(z, 0) - y[:, None] * z + np.log1p(np.exp(-np.abs(z)))).sum(axis=0)
                    chance = 1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700)))
                    curved = (x * (chance * (1 - chance))[:, None]).T @ x
                    part = np.concatenate([[len(rows)], losses, x.T @ (chance - y), curved[upper]])
                    key = site, round_no
                    total[key] = total[key] + part if key in total else part
        yield pd.DataFrame({"site": [s for s, _ in total], "round": [r for _, r in total], "part": list(total.values())})

    wanted = df.where(F.col("site").isin(sorted(by_site))).select("site", "label", *features)
    parts = wanted.mapInPandas(sums, "site string, round int, part array<double>")
    numbers = parts.select("site", "round", F.posexplode("part").alias("i", "v")).groupBy("site", "round", "i").agg(F.sum("v").alias("v"))
    packed = numbers.groupBy("site", "round").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    packed = packed.select("site", "round", F.transform("s", lambda e: e["v"]).alias("s"))
    rows = [
        {
            "site": site,
            "round": round_no,
            "w": w.tolist(),
            "norms": ((trials[:, :p] ** 2).sum(axis=1) / 2).tolist(),
        }
        for site, given in by_site.items()
        for round_no, w, trials in given
    ]
    known = local_table(df.sparkSession, rows, "site string, round int, w array<double>, norms array<double>")
    first = extra + 2
    diagonal = np.flatnonzero((upper[0] == upper[1]) & (upper[0] < p)).tolist()
    cost = number(c)
    return lookup_join(packed, known, ["site", "round"], "inner").selectExpr(
        "site",
        "round",
        "CAST(s[0] AS BIGINT) AS n",
        f"{cost} * s[1] + norms[0] AS loss",
        f"transform(slice(s, {first + 1}, {p + 1}), (g, i) -> {cost} * g + IF(i < {p}, w[i], 0D)) AS gradient",
        f"transform(slice(s, {first + p + 2}, {len(upper[0])}), (h, i) -> {cost} * h + IF(array_contains(array({', '.join(map(str, diagonal))}), i), 1D, 0D)) AS hessian",
        f"transform(slice(s, 3, {extra}), (l, i) -> {cost} * l + norms[i + 1]) AS losses",
    )


def newton_direction(gradient: Sequence[float], hessian: Sequence[float]) -> np.ndarray:
    """The step to the minimum of the parabola; `hessian` is an upper triangle by rows.

    A penalty makes the Hessian positive definite but for the intercept, whose curvature may vanish where all
    predictions are certain; the smallest least-squares step is taken then.
    """
    g = np.asarray(gradient, dtype="float64")
    whole = np.zeros((len(g), len(g)))
    whole[np.triu_indices(len(g))] = hessian
    whole += np.triu(whole, 1).T
    return -np.linalg.lstsq(whole, g, rcond=None)[0]


def lr_newton_fit(
    train: DataFrame,
    start: Mapping[Key, Sequence[float]],
    features: Sequence[str],
    iterations: int = 5,
    c: float = 1.0,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Newton steps from each start vector, keyed by site and round; the result is that of `lr_local_fit`'s table.

    One job serves all sites and rounds: it evaluates the full step of everyone together with the losses of the SHORTER
    ones. Where the full step does not lower the loss enough, the longest shorter stride that does is evaluated by the
    next job, beside the next steps of the others; where none does, the search goes on below the shortest. Callers keep
    `train` persisted.
    """
    spark = train.sparkSession

    def evaluate(points: Mapping[Key, np.ndarray], others: Mapping[Key, list[np.ndarray]]) -> dict[Key, tuple]:
        found = lr_curvature(train, points, features, c, others).collect()
        return {(r["site"], r["round"]): (r["loss"], np.asarray(r["gradient"]), r["hessian"], r["n"], r["losses"]) for r in found}

    w = {key: np.asarray(v, dtype="float64") for key, v in start.items()}
    state = evaluate(w, {key: [] for key in w}) if w else {}
    active = {key: (newton_direction(state[key][1], state[key][2]), 1.0, 0) for key in state}
    taken = dict.fromkeys(active, 0)
    while active:
        trials = {k: w[k] + stride * d for k, (d, stride, _) in active.items()}
        shorter = {k: [w[k] + stride * share * d for share in SHORTER] for k, (d, stride, _) in active.items()}
        outcome = evaluate(trials, shorter)
        for key, (direction, stride, tries) in list(active.items()):
            loss, gradient, hessian, n, losses = outcome[key]
            slope = direction @ state[key][1]

            def enough(value: float, length: float, before: float = state[key][0], slope: float = slope) -> bool:
                return value <= before + ARMIJO * length * slope

            if enough(loss, stride):
                w[key], state[key] = trials[key], outcome[key]
                taken[key] += 1
                if taken[key] >= iterations or np.abs(gradient).max() <= tolerance * max(1.0, c * n):
                    del active[key]
                else:
                    active[key] = newton_direction(gradient, hessian), 1.0, 0
                continue
            fits = [share for share, value in zip(SHORTER, losses, strict=True) if enough(value, stride * share)]
            if tries >= 5:  # beyond the precision of the loss
                del active[key]
            else:
                active[key] = direction, stride * (fits[0] if fits else SHORTER[-1] / 2), tries + 1
    return params_table(
        spark,
        [{"model": "LR", "site": s, "round": r, "n_train": int(state[s, r][3]), "w": w[s, r].tolist()} for s, r in state],
    )
