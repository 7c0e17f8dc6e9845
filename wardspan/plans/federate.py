"""Federated rounds: local fits, weighted averages, evaluation of every site, personalised models.

Only the rounds' local fits depend on one another. Evaluation and personalised training of all rounds are
therefore batched: every encounter is scored with the parameters of all rounds in one pass, with `round`
as one more grouping column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.operators.curves import delong_test, roc_curve
from wardspan.operators.logistic import lr_local_fit, lr_newton_fit
from wardspan.operators.metrics import calibrate, evaluate_model, mean_threshold
from wardspan.operators.network import mlp_local_fit
from wardspan.operators.params import GLOBAL, fedavg_loss, glorot_weights, lr_size, params_table, weighted_mean
from wardspan.operators.report import continue_rounds, round_history
from wardspan.operators.scale import local_table, lookup_join, pin_small
from wardspan.operators.scoring import score_rows, threshold_label
from wardspan.operators.synchronous import mlp_site_fit
from wardspan.plans.cohorts import Prepared
from wardspan.session import write_stage
from wardspan.sources.store import RunStore
from wardspan.sources.tables import export_site_results
from wardspan.specs import RunSettings

EVALUATED = ("test", "validation")
OUTSIDE = ("external", "central")
KEYS = ["site", "split", "round"]
LR_SOLVERS = {"quasi-newton": lr_local_fit, "newton": lr_newton_fit}
P_VALUES = ["p_vs_round1", "p_lr_vs_nn"]


@dataclass(frozen=True)
class ScoredModel:
    """A model as it is applied: parameters keyed by `on`, thresholds keyed by `cut_on`."""

    model: str
    params: DataFrame
    thresholds: DataFrame
    on: tuple[str, ...] = ("round",)
    cut_on: tuple[str, ...] = ("site", "round")

    def at_round(self, round_no: int) -> ScoredModel:
        """The model of one round, to be applied to the rows of any round."""
        here = F.col("round") == round_no
        return replace(
            self,
            params=pin_small(self.params.where(here).drop("round"))[0],
            thresholds=pin_small(self.thresholds.where(here).drop("round"))[0],
            on=tuple(c for c in self.on if c != "round"),
            cut_on=("site",),
        )


@dataclass
class Federation:
    """What a run leaves behind."""

    params: list[DataFrame] = field(default_factory=list)
    thresholds: list[DataFrame] = field(default_factory=list)
    results: list[DataFrame] = field(default_factory=list)
    losses: list[DataFrame] = field(default_factory=list)
    roc: list[DataFrame] = field(default_factory=list)
    final: dict[str, ScoredModel] = field(default_factory=dict)
    #: Per model and round, the threshold at which evaluation-only sites are judged.
    shared: dict[str, dict[int, float]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), getattr(self, name))

    def history(self, lr_rounds: int) -> DataFrame:
        return continue_rounds(round_history(self.results), lr_rounds)


def round_numbers(params: DataFrame) -> list[int]:
    return sorted(row["round"] for row in params.select("round").distinct().collect())


def for_rounds(rows: DataFrame, rounds: Sequence[int]) -> DataFrame:
    return rows.withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))


def _scored(rows: DataFrame, applied: ScoredModel, settings: RunSettings, name: str = "p") -> DataFrame:
    return score_rows(rows, applied.params, applied.model, settings.features, applied.on, settings.nn_hidden, name)


def _labelled(rows: DataFrame, applied: ScoredModel, settings: RunSettings, name: str) -> DataFrame:
    """Add the model's score as `_p_<name>` and its 0/1 prediction as `name`."""
    scored = _scored(rows, applied, settings, f"_p_{name}")
    cuts = applied.thresholds.select(*applied.cut_on, F.col("threshold").alias("_cut"))
    cut = lookup_join(scored, cuts, applied.cut_on)
    return cut.withColumn(name, threshold_label(F.col(f"_p_{name}"), F.col("_cut"))).drop("_cut")


def calibrate_sites(rows: DataFrame, model: str, params: DataFrame, settings: RunSettings, per_site: bool = False) -> ScoredModel:
    """Every fitting site's threshold per round, on its test rows."""
    on = ("site", "round") if per_site else ("round",)
    test = for_rounds(rows.where(F.col("split") == "test"), round_numbers(params))
    scored = score_rows(test, params, model, settings.features, on, settings.nn_hidden)
    thresholds = calibrate(
        scored, ["site", "round"], settings.target_metric, settings.target_value, settings.tolerance, settings.prevalence
    )
    return ScoredModel(model, params, pin_small(thresholds, "thresholds")[0], on)


def compare_models(
    rows: DataFrame,
    one: ScoredModel,
    two: ScoredModel,
    settings: RunSettings,
    column: str,
    on: str = "label",
    ranges: Sequence[float] | None = None,
) -> DataFrame:
    """DeLong p value per site, split and round between two models scored on the same rows.

    As in the published study the 0/1 predictions are compared; `on="score"` compares the scores.
    """
    both = _labelled(_labelled(rows, one, settings, "a"), two, settings, "b")
    if on == "label":
        tested = delong_test(both, KEYS, "a", "b", splits=())
    else:
        tested = delong_test(both, KEYS, "_p_a", "_p_b", splits=ranges)
    return tested.select(*KEYS, F.col("p_value").alias(column))


def evaluate_applied(
    rows: DataFrame,
    applied: ScoredModel,
    settings: RunSettings,
    variant: str = "global",
    comparisons: Mapping[str, ScoredModel] | None = None,
    ranges: Sequence[float] | None = None,
) -> DataFrame:
    """Metric rows per site, split and round, with p values against other models.

    `ranges` are known score ranges (see `Prepared.splits`).
    """
    rows = for_rounds(rows, round_numbers(applied.params))
    scored = _scored(rows, applied, settings)
    result = evaluate_model(scored, applied.thresholds, KEYS, applied.cut_on, settings.level, ranges)
    for column, other in (comparisons or {}).items():
        result = result.join(compare_models(rows, other, applied, settings, column), KEYS, "left")
    missing = {c: F.lit(None).cast("double") for c in P_VALUES if c not in result.columns}
    return result.withColumns(
        {
            **missing,
            "model": F.lit(applied.model),
            "variant": F.lit(variant),
            "target_sensitivity": F.lit(settings.target_value),
        }
    )


def federated_evaluate(
    rows: DataFrame,
    applied: ScoredModel,
    settings: RunSettings,
    baseline: ScoredModel | None = None,
    lr_model: ScoredModel | None = None,
    ranges: Sequence[float] | None = None,
) -> DataFrame:
    """Test and validation rows of all fitting sites; the first round and the LR model are the references."""
    comparisons = {"p_vs_round1": baseline, "p_lr_vs_nn": lr_model}
    given = {column: model for column, model in comparisons.items() if model is not None}
    return evaluate_applied(rows.where(F.col("split").isin(*EVALUATED)), applied, settings, "global", given, ranges)


def evaluate_external(
    rows: DataFrame,
    model: str,
    params: DataFrame,
    shared: Mapping[int, float],
    settings: RunSettings,
    lr_model: ScoredModel | None = None,
    only: Sequence[str] = OUTSIDE,
    ranges: Sequence[float] | None = None,
) -> DataFrame:
    """Evaluation-only rows (`external`) and the server's own evaluation (`central`).

    Nothing is calibrated here: `shared` gives each round the mean threshold of the round before.
    """
    applied = ScoredModel(model, params, shared_thresholds(rows, shared, settings))
    given = {"p_lr_vs_nn": lr_model} if lr_model is not None else {}
    return evaluate_applied(rows.where(F.col("split").isin(*only)), applied, settings, "global", given, ranges)


def shared_thresholds(rows: DataFrame, shared: Mapping[int, float], settings: RunSettings) -> DataFrame:
    """The shared thresholds as rows of the evaluation-only sites."""
    outside = [s.name for s in settings.sites if not s.fits]
    cuts = [{"site": s, "round": r, "threshold": float(t)} for s in outside for r, t in shared.items()]
    return local_table(rows.sparkSession, cuts, "site string, round int, threshold double")


def local_fit(rows: DataFrame, model: str, start: Mapping[tuple[str, int], Sequence[float]], settings: RunSettings) -> DataFrame:
    """Local training from start vectors keyed by site and round."""
    if model == "LR":
        train = rows.where(F.col("split") == "train")
        return LR_SOLVERS[settings.lr_solver](train, start, settings.features, settings.lr_iterations, settings.lr_c)
    options = {"hidden": settings.nn_hidden, "epochs": settings.nn_epochs, "patience": settings.nn_patience, "batch": settings.nn_batch}
    if settings.nn_solver == "site":
        return mlp_site_fit(rows, start, settings.features, **options)
    fitted = mlp_local_fit(rows, start, settings.features, rows_per_shard=settings.nn_rows_per_shard, **options)
    return pin_small(fitted, "nn-params")[0]


def start_vector(model: str, settings: RunSettings) -> list[float]:
    if model == "LR":
        return [0.0] * lr_size(len(settings.features))
    return glorot_weights(len(settings.features), settings.nn_hidden).tolist()


def fedavg_rounds(rows: DataFrame, model: str, settings: RunSettings, rounds: int, store: RunStore | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The training rounds: local fits of all sites in shared jobs, then their weighted average.

    Returns the sites' parameters per round and the averaged vectors of all rounds. With a `store` every round is
    written as soon as it is averaged, and rounds found there are not trained again.
    """
    spark = rows.sparkSession
    sites = [s.name for s in settings.sites if s.fits]
    known = {}
    if store is not None and (done := store.done("params", model, "training")):
        for row in store.read("params").where((F.col("model") == model) & F.col("round").isin(sorted(done))).collect():
            known.setdefault(row["round"], []).append({c: row[c] for c in ("model", "site", "round", "n_train", "w")})
    vector, local, averaged = start_vector(model, settings), [], []
    for round_no in range(1, rounds + 1):
        if round_no in known:
            local.append(params_table(spark, [row for row in known[round_no] if row["site"] != GLOBAL]))
            averaged += [row for row in known[round_no] if row["site"] == GLOBAL]
        else:
            known = {}  # what follows a missing round was trained from something else
            fitted = local_fit(rows, model, {(s, round_no): vector for s in sites}, settings)
            local.append(fitted)
            found = fitted.collect()
            n_train = sum(row["n_train"] for row in found)
            averaged.append({"model": model, "site": GLOBAL, "round": round_no, "n_train": n_train, "w": weighted_mean(found)})
            if store is not None:
                store.write("params", fitted.unionByName(params_table(spark, averaged[-1:])), model, "training", [round_no])
        vector = averaged[-1]["w"]
    return local, params_table(spark, averaged)


def personalise(rows: DataFrame, applied: ScoredModel, settings: RunSettings, ranges: Sequence[float] | None = None) -> tuple[DataFrame, ScoredModel]:
    """Continue training at every site from each round's global parameters, calibrate again and evaluate.

    The p value in `p_vs_round1` compares with the global model of the same round.
    """
    sites = [s.name for s in settings.sites if s.fits]
    start = {(s, row["round"]): row["w"] for row in applied.params.collect() for s in sites}
    own = calibrate_sites(rows, applied.model, local_fit(rows, applied.model, start, settings), settings, per_site=True)
    validation = rows.where(F.col("split") == "validation")
    result = evaluate_applied(validation, own, settings, "personalised", {"p_vs_round1": applied}, ranges)
    return result, own


def roc_points(rows: DataFrame, applied: ScoredModel, settings: RunSettings, rounds: Sequence[int], ranges: Sequence[float] | None = None) -> DataFrame:
    """ROC points of the evaluation splits for some rounds."""
    judged = for_rounds(rows.where(F.col("split").isin("validation", *OUTSIDE)), rounds)
    curve = roc_curve(_scored(judged, applied, settings), KEYS, splits=ranges)
    return curve.withColumn("model", F.lit(applied.model))


def run_federation(
    prepared: Prepared,
    settings: RunSettings,
    models: Sequence[str] = ("LR", "NN"),
    with_personalised: bool = True,
    with_roc: bool = True,
    store: RunStore | None = None,
) -> Federation:
    """All rounds of the LR and then of the NN federation, with their evaluation.

    An evaluation-only site judges a round at the mean threshold of the round before it, also across models: the
    first network round uses the last regression round's. Before the very first round it is 0.
    Parameters, thresholds and result rows are a few per site and round; row-level tables never leave
    the cluster. The prepared rows stay persisted while the run reads them.

    With a `store` parameters, thresholds, results and ROC points are written round by round, and so is one CSV per site
    and variant at the end. A run that was stopped goes on after its last whole round; the prepared rows must be the same.
    """
    run, ranges = Federation(), prepared.splits
    rows = prepared.rows.persist(StorageLevel.MEMORY_AND_DISK)
    lr_inside = lr_outside = None
    carried, basis = 0.0, "all"

    def kept(table: str, model: str, part: str, numbers: Sequence[int], build: Callable[[list[int]], DataFrame]) -> DataFrame:
        made = build(list(numbers)) if store is None else store.rounds(table, model, part, numbers, build, basis)
        return pin_small(made, table)[0]

    for model in models:
        rounds = settings.lr_rounds if model == "LR" else settings.nn_rounds
        numbers = range(1, rounds + 1)
        local, averaged = fedavg_rounds(rows, model, settings, rounds, store)
        run.params += [*local, averaged]

        def only(chosen: Sequence[int], vectors: DataFrame = averaged) -> DataFrame:
            return vectors.where(F.col("round").isin(list(chosen)))

        thresholds = kept("thresholds", model, "sites", numbers, lambda r: calibrate_sites(rows, model, only(r), settings).thresholds)
        applied = ScoredModel(model, averaged, thresholds.drop("model"))
        run.thresholds.append(applied.thresholds.withColumn("model", F.lit(model)))
        means = {row["round"]: row["threshold"] for row in mean_threshold(applied.thresholds, ["round"]).collect()}
        shared = run.shared[model] = {r: means.get(r - 1, carried) for r in numbers}
        carried = means.get(rounds, carried)

        first = applied.at_round(1)
        judged = kept("results", model, "inside", numbers, lambda r: federated_evaluate(rows, replace(applied, params=only(r)), settings, first, lr_inside, ranges))
        run.results.append(judged)
        run.losses.append(fedavg_loss(judged.where("split = 'validation'")))
        if any(not s.fits for s in settings.sites):
            run.results.append(kept("results", model, "outside", numbers, lambda r: evaluate_external(rows, model, only(r), shared, settings, lr_outside, ranges=ranges)))
        if with_personalised:
            run.results.append(kept("results", model, "personalised", numbers, lambda r: personalise(rows, replace(applied, params=only(r)), settings, ranges)[0]))
        if with_roc:
            ends = sorted({1, rounds})
            if store is None:
                run.roc.append(write_stage(roc_points(rows, applied, settings, ends, ranges), "roc"))
            else:
                run.roc.append(store.rounds("roc", model, "ends", ends, lambda r: roc_points(rows, applied, settings, r, ranges), basis))
        run.final[model] = applied.at_round(rounds)
        if model == "LR":
            lr_inside = run.final[model]
            cuts = shared_thresholds(rows, {rounds: shared[rounds]}, settings)
            lr_outside = replace(applied, thresholds=cuts).at_round(rounds)
            # what the network's rows are compared with, and its first shared threshold, come from this round
            basis = f"after-LR-{rounds}"
    rows.unpersist()
    if store is not None:
        for site in settings.sites:
            variants = ["global", *(["personalised"] if with_personalised and site.fits else [])]
            export_site_results(run.table("results"), f"{store.root}/sites", site.name, site.trains_only, variants)
    return run


def fixed_params(spark, model: str, vector: Sequence[float]) -> DataFrame:
    """A given vector as a parameter table."""
    return params_table(spark, [{"model": model, "site": GLOBAL, "round": 1, "n_train": 1, "w": [float(v) for v in vector]}])
