"""One network per site, trained by synchronous steps over all of the site's rows.

Every step is one job: the tasks add up the gradients of their rows of the step's batch, and the driver, which holds the
optimiser's moments, moves the weights. All sites and start vectors share each job. The rows are dealt to batches once,
by a hash of their ids, and persisted as arrays in partitions of one batch each, so that a step is one stage over its own
partitions, without a plan, a scan or a shuffle; epochs differ in the order of the batches. Neither the number of
partitions nor of executors enters the result, but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wardspan.operators.network import CLIP, mlp_gradient_mean
from wardspan.operators.params import mlp_forward, mlp_size, params_table, unpack
from wardspan.operators.scale import local_table, lookup_join

#: Test rows have no batch.
TEST = -1
#: Cells of the validation scores: logits from -SPAN to SPAN, the outermost cells are open.
CELLS, SPAN = 2_048, 16.0
#: A step lasts about as long as one task, so its partitions are small.
ROWS_PER_PART = 50_000

Start = Mapping[tuple[str, int], Sequence[float]]


def score_cells(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logit = np.log(p) - np.log1p(-p)
    return np.clip((logit + SPAN) * (CELLS / (2 * SPAN)), 0, CELLS - 1).astype(np.int64)


def cell_auc(negative: np.ndarray, positive: np.ndarray) -> float:
    """AUC from counts per cell; pairs inside a cell count half. Undefined (nan) without both classes."""
    pairs = negative.sum() * positive.sum()
    return float(positive @ (np.cumsum(negative) - negative / 2) / pairs) if pairs else float("nan")


def _by_site(points: Mapping[int, tuple[str, np.ndarray]]) -> dict[str, list[tuple[int, np.ndarray]]]:
    by_site: dict[str, list[tuple[int, np.ndarray]]] = {}
    for k, (site, w) in points.items():
        by_site.setdefault(site, []).append((k, w))
    return by_site


def _arrays(batch: pa.RecordBatch, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
    return x, batch.column("label").to_numpy(zero_copy_only=False).astype("float64")


def _sums(rows: DataFrame, points: Mapping[int, tuple[str, np.ndarray]], features: list[str], hidden: int) -> dict[int, np.ndarray]:
    """For each point, a site and a weight vector, over the site's rows: gradient, cross-entropy and their number.

    A task emits a row per number that is not 0, and these are added up by hash; the driver gets one set for each point.
    """
    size = mlp_size(len(features), hidden)
    by_site = _by_site(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = _arrays(batch, features)
            site_of = np.asarray(batch.column("site").to_pylist())
            for site, fits in by_site.items():
                here = site_of == site
                if n := int(here.sum()):
                    for k, w in fits:
                        sums = total.setdefault(k, np.zeros(size + 2))
                        p = np.clip(mlp_forward(x[here], unpack(w, len(features), hidden))[1], 1e-300, 1 - 1e-16)
                        sums[:size] += n * mlp_gradient_mean(x[here], y[here], w, hidden)
                        sums[size:] += -np.log(np.where(y[here] == 1, p, 1 - p)).sum(), n
        for k, sums in total.items():
            idx = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"point": pa.array(np.full(len(idx), k), pa.int32()), "idx": pa.array(idx, pa.int32()), "v": sums[idx]})

    narrow = rows.select("site", F.col("label").cast("double").alias("label"), *features)
    added = narrow.mapInArrow(run, "point int, idx int, v double").groupBy("point", "idx").agg(F.sum("v").alias("v")).toArrow()
    out = {k: np.zeros(size + 2) for k in points}
    for k, idx, v in zip(*(added.column(c).to_pylist() for c in ("point", "idx", "v")), strict=True):
        out[k][idx] = v
    return out


def mlp_gradient(train: DataFrame, start: Start, features: Sequence[str], hidden: int = 10) -> DataFrame:
    """Rows, mean cross-entropy and its gradient for each site and round at its vector: `(site, round, n, loss, gradient)`.

    All rows of `train` count. A site without rows has no result.
    """
    features, keys = list(features), list(start)
    size = mlp_size(len(features), hidden)
    rows = train.select("site", "label", *[F.col(f).cast("double") for f in features])
    sums = _sums(rows, {k: (key[0], np.asarray(start[key], "float64")) for k, key in enumerate(keys)}, features, hidden)
    found = [
        {"site": site, "round": number, "n": int(v[size + 1]), "loss": float(v[size] / v[size + 1]), "gradient": (v[:size] / v[size + 1]).tolist()}
        for (site, number), v in zip(keys, sums.values(), strict=True)
        if v[size + 1]
    ]
    return local_table(train.sparkSession, found, "site string, round int, n long, loss double, gradient array<double>")


@dataclass(frozen=True)
class Batches:
    """Dealt rows: `blocks` are (site, testing, x, y) in partitions that hold rows of one batch or test rows only.

    `parts` lists the partitions of each batch and of TEST, `n_train` and `steps` training rows and batches of each site.
    """

    blocks: RDD
    parts: Mapping[int, Sequence[int]]
    n_train: Mapping[str, int]
    steps: Mapping[str, int]


def deal_batches(prepared: DataFrame, features: Sequence[str], batch: int, most_steps: int, seed: int, key: str) -> Batches:
    """Training rows dealt to batches and test rows, as arrays that stay with the executors.

    A site has as many batches of about `batch` rows as it needs, but `most_steps` at most: larger sites have larger batches,
    so that the number of jobs does not grow with the data. A batch has a partition per ROWS_PER_PART rows. Partitions that
    are lost are dealt again by the same hashes.
    """
    features = list(features)
    used = prepared.where(F.col("split").isin("train", "test"))
    training = F.col("split") == "train"
    counted = used.groupBy("site").agg(F.count_if(training).alias("n"), F.count_if(~training).alias("n_test")).collect()
    n_train = {row["site"]: row["n"] for row in counted if row["n"]}
    steps = {site: min(most_steps, math.ceil(n / batch)) for site, n in n_train.items()}
    rows = {step: sum(n_train[site] / n for site, n in steps.items() if step < n) for step in range(max(steps.values(), default=0))}
    rows[TEST] = sum(row["n_test"] for row in counted if row["site"] in n_train)
    parts, end = {}, 0
    for step, n in rows.items():
        parts[step] = range(end, end + max(1, math.ceil(n / ROWS_PER_PART)))
        end = parts[step].stop
    table = local_table(prepared.sparkSession, [{"site": s, "n_steps": n} for s, n in steps.items()], "site string, n_steps int")
    places = local_table(prepared.sparkSession, [{"step": s, "first": p.start, "n_parts": len(p)} for s, p in parts.items()], "step int, first int, n_parts int")
    hashed = F.pmod(F.xxhash64(key, F.lit(seed)), F.col("n_steps")).cast("int")
    dealt = lookup_join(used, table, ["site"], "inner").select(
        "site", (~training).alias("testing"), F.col("label").cast("double").alias("label"), *[F.col(f).cast("double") for f in features],
        F.when(training, hashed).otherwise(F.lit(TEST)).alias("step"),
        F.xxhash64(key, *features, F.lit(seed + 1)).alias("turn"),
    )
    part = (F.col("first") + F.pmod("turn", F.col("n_parts"))).cast("int")
    placed = lookup_join(dealt, places, ["step"], "inner").withColumn("part", part).drop("step", "turn", "first", "n_parts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for site in pc.unique(given.column("site")):
                here = given.filter(pc.equal(given.column("site"), site))
                if here.num_rows:
                    x, y = _arrays(here, features)
                    yield pa.RecordBatch.from_pydict({"site": [site.as_py()], "testing": [here.column("testing")[0].as_py()], "x": [x.tobytes()], "y": [y.tobytes()]})

    def join(packed: Iterator[Row]) -> Iterator[tuple]:
        found: dict[tuple, list] = {}
        for row in packed:
            y = np.frombuffer(row["y"])
            found.setdefault((row["site"], row["testing"]), []).append((np.frombuffer(row["x"]).reshape(len(y), len(features)), y))
        for name, held in found.items():
            yield (*name, *(np.concatenate(arrays) for arrays in zip(*held, strict=True)))

    packed = placed.repartitionById(end, "part").drop("part").mapInArrow(pack, "site string, testing boolean, x binary, y binary")
    return Batches(packed.rdd.mapPartitions(join), parts, n_train, steps)


def _step_sums(batches: Batches, wanted: Sequence[int], points: Mapping[int, tuple[str, np.ndarray]], hidden: int) -> dict[int, dict[bool, np.ndarray]]:
    """For each point the gradient and number of its site's rows in the wanted batch (False), and its test rows' score cells by
    label (True). One job over the partitions of these rows only; a task sends one set of sums for each point."""
    by_site = _by_site(points)

    def add(blocks: Iterator[tuple]) -> Iterator[tuple[int, bool, np.ndarray]]:
        for site, testing, x, y in blocks:
            for k, w in by_site.get(site, ()):
                if testing:
                    at = score_cells(mlp_forward(x, unpack(w, x.shape[1], hidden))[1]) + CELLS * (y == 1)
                    yield k, testing, np.bincount(at, minlength=2 * CELLS)
                else:
                    yield k, testing, len(y) * np.append(mlp_gradient_mean(x, y, w, hidden), 1.0)

    out: dict[int, dict[bool, np.ndarray]] = {k: {} for k in points}
    for k, testing, sums in batches.blocks.context.runJob(batches.blocks, add, [part for step in wanted for part in batches.parts[step]]):
        out[k][testing] = out[k].get(testing, 0) + sums
    return out


@dataclass
class Fit:
    """Weights and optimiser state of one site and round."""

    site: str
    round: int
    w: np.ndarray
    best: np.ndarray = field(init=False)
    best_auc: float = -math.inf
    turn: int = 0
    since: int = 0
    epochs: int = 0

    def __post_init__(self):
        self.best, self.first, self.second = self.w.copy(), np.zeros_like(self.w), np.zeros_like(self.w)

    def move(self, gradient: np.ndarray, rate: float) -> None:
        """One step of Adam."""
        self.turn += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        self.w = self.w - rate * (self.first / (1 - 0.9**self.turn)) / (np.sqrt(self.second / (1 - 0.999**self.turn)) + CLIP)

    def judge(self, auc: float) -> None:
        """Keep the weights if no earlier epoch did better; without an AUC always."""
        self.epochs += 1
        if math.isnan(auc) or auc > self.best_auc:
            self.best, self.since = self.w, 0
            self.best_auc = self.best_auc if math.isnan(auc) else auc
        else:
            self.since += 1


def train_sites(
    prepared: DataFrame,
    start: Start,
    features: Sequence[str],
    hidden: int = 10,
    epochs: int = 50,
    patience: int = 15,
    batch: int = 4096,
    most_steps: int = 64,
    rate: float = 0.001,
    seed: int = 20,
    key: str = "encounter_id",
) -> tuple[list[Fit], dict[str, int]]:
    """The fits of every site and round in `start` whose site has training rows, and the sites' training rows.

    The AUC of the test rows after an epoch is read in the job of the next epoch's first step, from counts in CELLS score
    cells. A fit ends after `patience` epochs without a better one and keeps the weights of its best.
    """
    batches = deal_batches(prepared, features, batch, most_steps, seed, key)
    steps = batches.steps
    fits = [Fit(site, number, np.asarray(w, "float64")) for (site, number), w in start.items() if site in steps]
    if not fits:
        return fits, dict(batches.n_train)
    rng = np.random.default_rng(seed)
    batches.blocks.persist(StorageLevel.MEMORY_AND_DISK).count()
    try:
        for epoch in range(1, epochs + 2):
            order = rng.permutation(max(steps.values())) if epoch <= epochs else [TEST]
            for turn, step in enumerate(order):
                judging = turn == 0 and epoch > 1
                live = {k: f for k, f in enumerate(fits) if f.since < patience and (judging or step < steps[f.site])}
                if not live:
                    continue
                wanted = sorted({int(step), *([TEST] if judging else [])})
                sums = _step_sums(batches, wanted, {k: (f.site, f.w) for k, f in live.items()}, hidden)
                for k, fit in live.items():
                    if judging:
                        fit.judge(cell_auc(*np.split(sums[k].get(True, np.zeros(2 * CELLS)), 2)))
                    if fit.since < patience and False in sums[k]:
                        fit.move(sums[k][False][:-1] / sums[k][False][-1], rate)
            if all(f.since >= patience for f in fits):
                break
    finally:
        batches.blocks.unpersist()
    return fits, dict(batches.n_train)


def mlp_site_fit(prepared: DataFrame, start: Start, features: Sequence[str], **options) -> DataFrame:
    """Parameters per site and round in the form of `mlp_local_fit`, each from one fit over the whole site (`train_sites`)."""
    fits, n_train = train_sites(prepared, start, features, **options)
    found = [{"model": "NN", "site": f.site, "round": f.round, "n_train": n_train[f.site], "w": f.best.tolist()} for f in fits]
    return params_table(prepared.sparkSession, found)
