"""Local fits, averaging, evaluation rounds, attributions, reports."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.operators import explain, network, params, report, synchronous
from wardspan.operators.logistic import SHORTER, lr_curvature, lr_gradient, lr_local_fit, lr_newton_fit, newton_direction
from wardspan.operators.scale import local_table
from wardspan.operators.scoring import score_rows
from wardspan.plans import federate
from wardspan.plans.cohorts import prepare
from wardspan.sources.encounters import encounters, order_settings

RNG = np.random.default_rng(11)
X = ["x1", "x2", "x3"]


def sample(n=600):
    x = RNG.random((n, 3))
    y = (x @ [3.0, -2.0, 1.0] + RNG.normal(size=n) > 1).astype(int)
    frame = pd.DataFrame(x, columns=X)
    return frame.assign(encounter_id=np.arange(n), label=y, site=np.where(np.arange(n) % 4 == 0, "A", "B"), split=np.where(np.arange(n) % 5 == 0, "test", "train"))


DATA = sample()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA).repartition(6)


def objective(w, g, c):
    z = g[X].to_numpy() @ w[:-1] + w[-1]
    return 0.5 * (w[:-1] @ w[:-1]) + c * (np.logaddexp(0, z) - g.label * z).sum()


def numeric_gradient(f, w, h=1e-6):
    return np.array([(f(w + h * e) - f(w - h * e)) / (2 * h) for e in np.eye(len(w))])


def test_lr_gradient_is_the_derivative(spark, rows):
    points = {("A", 1): [0.3, -0.2, 0.1, 0.4], ("B", 1): [0.0] * 4, ("B", 2): [-1.0, 2.0, 0.5, -0.5]}
    table = local_table(spark, [{"site": s, "round": r, "w": w} for (s, r), w in points.items()], "site string, round int, w array<double>")
    found = {(r.site, r["round"]): r for r in lr_gradient(rows, table, X, 0.7, ("site", "round")).collect()}
    assert set(found) == set(points)
    for (site, number), w in points.items():
        group, row = DATA[DATA.site == site], found[(site, number)]
        assert row.n == len(group)
        assert math.isclose(row.loss, objective(np.array(w), group, 0.7), rel_tol=1e-10)
        expected = numeric_gradient(lambda v, g=group: objective(v, g, 0.7), np.array(w))
        assert np.allclose(row.gradient, expected, rtol=1e-5, atol=1e-4)


def test_gradients_are_summed_by_hash(spark, rows):
    table = local_table(spark, [{"site": "A", "w": [0.0] * 4}], "site string, w array<double>")
    plan = lr_gradient(rows, table, X)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def newton(g, c=1.0):
    x, w = np.column_stack([g[X], np.ones(len(g))]), np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(ridge + c * (x.T * (p * (1 - p))) @ x, ridge @ w + c * x.T @ (p - g.label))
    return w


def test_lr_fit_reaches_the_optimum(rows):
    start = {("A", 1): [0.0] * 4, ("B", 1): [5.0, 5.0, -5.0, 1.0]}
    fitted = {r.site: r for r in lr_local_fit(rows, start, X, iterations=60, tolerance=1e-9).collect()}
    for site, group in DATA.groupby("site"):
        assert np.allclose(fitted[site].w, newton(group), atol=1e-4)
        assert fitted[site].n_train == len(group)


def test_few_iterations_improve_from_the_start(rows):
    start = {("A", 3): [0.0] * 4, ("absent", 3): [0.0] * 4}
    fitted = lr_local_fit(rows, start, X).collect()
    assert [r.site for r in fitted] == ["A"] and fitted[0]["round"] == 3
    group = DATA[DATA.site == "A"]
    assert objective(np.array(fitted[0].w), group, 1.0) < objective(np.zeros(4), group, 1.0)


def test_curvature_is_the_second_derivative(rows):
    points = {("A", 1): [0.3, -0.2, 0.1, 0.4], ("A", 2): [0.0] * 4, ("B", 2): [-1.0, 2.0, 0.5, -0.5], ("absent", 1): [0.0] * 4}
    others = {key: [[0.5 * v for v in w], [0.0] * 4] for key, w in points.items()}
    found = {(r.site, r["round"]): r for r in lr_curvature(rows, points, X, 0.7, others).collect()}
    assert set(found) == set(points) - {("absent", 1)}
    for key, row in found.items():
        group, w = DATA[DATA.site == key[0]], np.array(points[key])
        assert row.n == len(group) and math.isclose(row.loss, objective(w, group, 0.7), rel_tol=1e-10)
        assert np.allclose(row.gradient, numeric_gradient(lambda v, g=group: objective(v, g, 0.7), w), rtol=1e-5, atol=1e-4)
        assert np.allclose(row.losses, [objective(np.array(v), group, 0.7) for v in others[key]])
        second = [numeric_gradient(lambda v, i=i, g=group: numeric_gradient(lambda u: objective(u, g, 0.7), v, 1e-3)[i], w, 1e-3) for i in range(4)]
        assert np.allclose(row.hessian, np.array(second)[np.triu_indices(4)], rtol=1e-3, atol=1e-3)
    assert lr_curvature(rows.where("false"), points, X).count() == 0
    split = {(r.site, r["round"]): r.hessian for r in lr_curvature(rows.repartition(17), points, X, 0.7).collect()}
    assert all(np.allclose(split[key], row.hessian, rtol=1e-12) for key, row in found.items())


def test_newton_fit_reaches_the_optimum(rows):
    start = {("A", 1): [0.0] * 4, ("B", 1): [50.0, 50.0, -50.0, 10.0], ("absent", 1): [0.0] * 4}
    fitted = {r.site: r for r in lr_newton_fit(rows, start, X, iterations=30, tolerance=1e-9).collect()}
    assert set(fitted) == {"A", "B"}
    for site, group in DATA.groupby("site"):
        assert np.allclose(fitted[site].w, newton(group), atol=1e-6) and fitted[site].n_train == len(group)
    five = lr_newton_fit(rows, {("A", 2): [0.0] * 4}, X).first()
    assert np.allclose(five.w, newton(DATA[DATA.site == "A"]), atol=1e-3) and five["round"] == 2
    assert lr_newton_fit(rows, {}, X).count() == 0 and sorted(SHORTER, reverse=True) == list(SHORTER)


def test_newton_direction_without_curvature():
    assert np.allclose(newton_direction([2.0, 0.0], [4.0, 0.0, 0.0]), [-0.5, 0.0])


def test_rounds_by_newton_steps(spark, sf):
    prepared = prepare(encounters(spark, sf), order_settings(), matched=False)
    ends = {}
    for solver in ("quasi-newton", "newton"):
        settings = order_settings(lr_solver=solver, lr_iterations=40)
        _, averaged = federate.fedavg_rounds(prepared.rows, "LR", settings, 1)
        ends[solver] = averaged.first().w
    assert np.allclose(ends["newton"], ends["quasi-newton"], atol=0.02)


def test_pack_and_unpack():
    w = np.arange(params.mlp_size(3, 2), dtype=float)
    assert np.array_equal(params.pack(*params.unpack(w, 3, 2)), w)
    assert params.mlp_size(27, 10) == 291


def test_mlp_gradient_is_the_derivative():
    x, y = DATA[X].to_numpy()[:40], DATA.label.to_numpy()[:40].astype(float)
    w = RNG.normal(size=params.mlp_size(3, 4))

    def loss(v):
        p = params.mlp_forward(x, params.unpack(v, 3, 4))[1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    assert np.allclose(network.mlp_gradient_mean(x, y, w, 4), numeric_gradient(loss, w), atol=1e-6)


@pytest.mark.parametrize("hidden", [2, 50])
def test_mlp_scores_in_the_jvm_and_in_batches(spark, rows, hidden):
    w = {s: RNG.normal(size=params.mlp_size(3, hidden)) for s in ("A", "B")}
    table = local_table(spark, [{"site": s, "w": v.tolist()} for s, v in w.items()], "site string, w array<double>")
    found = score_rows(rows, table, "NN", X, ["site"], hidden).toPandas().sort_values("encounter_id")
    for site, group in found.groupby("site"):
        assert np.allclose(group.p, params.mlp_forward(group[X].to_numpy(), params.unpack(w[site], 3, hidden))[1])


def test_mlp_fit_is_repeatable_and_learns(rows):
    start = params.glorot_weights(3, 6).tolist()
    key = {("A", 1): start, ("B", 1): start, ("B", 2): start}
    options = {"hidden": 6, "epochs": 400, "patience": 400, "batch": 32}
    one = network.mlp_shard_fit(rows, key, X, **options).toPandas().sort_values(["site", "round"])
    two = network.mlp_shard_fit(rows.repartition(2), key, X, **options).toPandas().sort_values(["site", "round"])
    assert len(one) == 3 and (one.shard == 0).all()
    for row in one.itertuples():
        group = DATA[DATA.site == row.site]
        x, y = group[group.split == "test"][X].to_numpy(), group[group.split == "test"].label.to_numpy()
        truth = network.rank_auc(x @ [3.0, -2.0, 1.0], y)  # the score the labels were drawn from
        untrained = network.rank_auc(params.mlp_forward(x, params.unpack(np.array(start), 3, 6))[1], y)
        assert row.val_auc > max(untrained, truth - 0.1)
    assert np.allclose(np.stack(one.w), np.stack(two.w))


def test_large_sites_are_trained_in_shards(rows):
    start = {(s, 1): params.glorot_weights(3, 2).tolist() for s in ("A", "B")}
    options = {"hidden": 2, "epochs": 2, "rows_per_shard": 100}
    shards = network.mlp_shard_fit(rows, start, X, **options).toPandas()
    n_train = ((DATA.site == "B") & (DATA.split == "train")).sum()
    assert shards[shards.site == "B"].shard.nunique() == -(-n_train // 100) > 1
    fitted = {r.site: r for r in network.mlp_local_fit(rows, start, X, **options).collect()}
    for site, part in shards.groupby("site"):
        mean = np.average(np.stack(part.w), axis=0, weights=part.n_train)
        assert np.allclose(fitted[site].w, mean) and fitted[site].n_train == part.n_train.sum()


def dealt(site, batch, seed, rows):
    """Training rows with their batch, test rows, and the number of batches of a site."""
    hashed = rows.where((F.col("site") == site) & (F.col("split") == "train"))
    n_steps = -(-hashed.count() // batch)
    ids = hashed.select("encounter_id", F.pmod(F.xxhash64("encounter_id", F.lit(seed)), F.lit(n_steps)).alias("step")).toPandas()
    group = DATA[DATA.site == site].merge(ids, how="left", on="encounter_id")
    train, test = group[group.split == "train"], group[group.split == "test"]
    return train, test, n_steps


@pytest.mark.parametrize("patience", [3, 40])
def test_site_fit_equals_one_machine(rows, patience):
    start = params.glorot_weights(3, 4)
    options = {"hidden": 4, "epochs": 6, "patience": patience, "batch": 100, "rate": 0.05, "seed": 5}
    key = {("A", 1): start.tolist(), ("B", 1): start.tolist(), ("B", 2): (2 * start).tolist(), ("nowhere", 1): start.tolist()}
    fits, n_train = synchronous.train_sites(rows, key, X, **options)
    assert [(f.site, f.round) for f in fits] == [("A", 1), ("B", 1), ("B", 2)]
    parts = {s: dealt(s, 100, 5, rows) for s in ("A", "B")}
    longest = max(n for _, _, n in parts.values())
    for fit in fits:
        train, test, n_steps = parts[fit.site]
        assert n_train[fit.site] == len(train) and n_steps > 1
        alone = synchronous.Fit(fit.site, fit.round, np.array(key[fit.site, fit.round]))
        rng = np.random.default_rng(5)
        for _ in range(6):
            for step in rng.permutation(longest):
                part = train[train.step == step]
                if len(part) and alone.since < patience:
                    alone.move(network.mlp_gradient_mean(part[X].to_numpy(), part.label.to_numpy(float), alone.w, 4), 0.05)
            if alone.since < patience:
                cells = synchronous.score_cells(params.mlp_forward(test[X].to_numpy(), params.unpack(alone.w, 3, 4))[1])
                counts = [np.bincount(cells[test.label == c], minlength=synchronous.CELLS) for c in (0, 1)]
                alone.judge(synchronous.cell_auc(*counts))
        assert np.allclose(fit.best, alone.best, atol=1e-9) and (fit.epochs, fit.turn) == (alone.epochs, alone.turn)


def test_steps_find_their_rows_in_partitions_of_their_own(rows, monkeypatch):
    monkeypatch.setattr(synchronous, "ROWS_PER_PART", 30)
    batches = synchronous.deal_batches(rows, X, 100, 64, 5, "encounter_id")
    held = batches.blocks.map(lambda block: (block[0], block[1], len(block[2]), len(block[3]))).glom().collect()
    assert [p for parts in batches.parts.values() for p in parts] == list(range(len(held))) and all(len(parts) > 1 for parts in batches.parts.values())
    expected = {site: dealt(site, 100, 5, rows) for site in batches.steps}
    for step, parts in batches.parts.items():
        found = [block for p in parts for block in held[p]]
        assert all(testing == (step == synchronous.TEST) and n == n_labels for _, testing, n, n_labels in found)
        for site, (train, test, _) in expected.items():
            assert sum(n for name, _, n, _ in found if name == site) == len(test if step == synchronous.TEST else train[train.step == step])
    w = params.glorot_weights(3, 4)
    sums = synchronous._step_sums(batches, [0, synchronous.TEST], {0: ("A", w)}, 4)[0]
    train, test, _ = expected["A"]
    part = train[train.step == 0]
    assert sums[False][-1] == len(part) and sums[True].sum() == len(test)
    assert np.allclose(sums[False][:-1] / len(part), network.mlp_gradient_mean(part[X].to_numpy(), part.label.to_numpy(float), w, 4))


def test_site_fit_ignores_the_partitions(rows):
    start = {(s, 1): params.glorot_weights(3, 4).tolist() for s in ("A", "B")}
    options = {"hidden": 4, "epochs": 3, "batch": 150}
    tables = [network_fit.toPandas().sort_values("site") for network_fit in (synchronous.mlp_site_fit(r, start, X, **options) for r in (rows, rows.repartition(2)))]
    assert np.allclose(np.stack(tables[0].w), np.stack(tables[1].w), atol=1e-9)
    assert tables[0].n_train.tolist() == [((DATA.site == s) & (DATA.split == "train")).sum() for s in ("A", "B")]
    assert synchronous.mlp_site_fit(rows.where("false"), start, X, **options).isEmpty()


def test_site_gradient_is_the_mean_over_all_rows(rows):
    start = {(s, r): (r * params.glorot_weights(3, 4)).tolist() for s in ("A", "B") for r in (1, 2)}
    for row in synchronous.mlp_gradient(rows, start, X, 4).collect():
        group = DATA[DATA.site == row.site]
        w = np.array(start[row.site, row["round"]])
        x, y = group[X].to_numpy(), group.label.to_numpy(float)
        p = params.mlp_forward(x, params.unpack(w, 3, 4))[1]
        assert row.n == len(group) and np.allclose(row.gradient, network.mlp_gradient_mean(x, y, w, 4))
        assert np.isclose(row.loss, -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def test_auc_from_score_cells():
    y, p = RNG.integers(0, 2, 3_000), RNG.random(3_000)
    p = 1 / (1 + np.exp(-(4 * p + y)))
    cells = synchronous.score_cells(p)
    counts = [np.bincount(cells[y == c], minlength=synchronous.CELLS) for c in (0, 1)]
    assert abs(synchronous.cell_auc(*counts) - network.rank_auc(p, y)) < 2e-3
    assert np.isnan(synchronous.cell_auc(counts[0], 0 * counts[1]))
    assert synchronous.score_cells(np.array([0.0, 1.0, 1e-9, 1 - 1e-9])).tolist() == [0, 2047, 0, 2047]


def test_rank_auc():
    p, y = np.array([0.1, 0.4, 0.4, 0.8]), np.array([0, 0, 1, 1])
    assert network.rank_auc(p, y) == 0.875 and math.isnan(network.rank_auc(p, np.ones(4)))


def test_fedavg(spark):
    rows = [{"model": "LR", "site": s, "round": 1, "n_train": n, "w": w} for s, n, w in (("A", 1, [1.0, 2.0]), ("B", 3, [5.0, 0.0]))]
    table = params.params_table(spark, rows)
    vector = params.fedavg_vectors(table).first()
    assert vector.site == "GLOBAL" and vector.n_train == 4 and vector.w == [4.0, 0.5]
    assert params.weighted_mean(table.collect()) == [4.0, 0.5]


@pytest.mark.parametrize("model", ["LR", "NN"])
def test_exact_shapley_is_the_mean_over_all_orders(rows, model):
    from itertools import permutations

    from wardspan.operators.prepare import sample_rows

    hidden = 3
    w = [2.0, -1.0, 0.5, -0.4] if model == "LR" else np.linspace(-1.5, 2, params.mlp_size(3, hidden)).tolist()
    few = rows.where("encounter_id < 12")
    base = sample_rows(rows, 20).select(*X).toPandas().to_numpy()

    def mean(x):
        return (x @ np.array(w[:3]) + w[3] > 0).mean() if model == "LR" else params.mlp_forward(x, params.unpack(np.array(w), 3, hidden))[1].mean()

    exact = explain.shapley_exact(few, rows, w, model, X, hidden, n_background=20).toPandas().pivot(index="encounter_id", columns="feature", values="phi")
    for i, given in DATA[DATA.encounter_id < 12].set_index("encounter_id")[X].iterrows():
        want = np.zeros(3)
        for order in permutations(range(3)):
            x = base.copy()
            for j in order:
                before = mean(x)
                x[:, j] = given.iloc[j]
                want[j] += (mean(x) - before) / 6
        assert np.allclose(exact.loc[i, X], want)
    sampled = explain.shapley_sampled(few, rows, w, model, X, hidden, n_background=20, permutations=40).toPandas()
    sampled = sampled.pivot(index="encounter_id", columns="feature", values="phi")
    assert np.abs(sampled[X] - exact[X]).to_numpy().max() < 0.1
    assert explain.shapley_exact(few.where("false"), rows, w, model, X, hidden).count() == 0
    with pytest.raises(ValueError, match="coalitions"):
        explain.shapley_exact(few, rows, w, model, X * 5, hidden)


@pytest.mark.parametrize("model", ["LR", "NN"])
def test_shapley_adds_up(spark, rows, model):
    hidden = 3
    w = [2.0, -1.0, 0.5, -0.4] if model == "LR" else RNG.normal(size=params.mlp_size(3, hidden)).tolist()
    few = rows.where("encounter_id < 30")
    phi = explain.shapley_sampled(few, rows, w, model, X, hidden, n_background=50, permutations=3).toPandas()
    again = explain.shapley_sampled(few.repartition(3), rows, w, model, X, hidden, n_background=50, permutations=3).toPandas()
    keys = ["encounter_id", "feature"]
    assert np.allclose(phi.sort_values(keys).phi, again.sort_values(keys).phi)

    def predict(x):
        if model == "LR":
            return (x @ np.array(w[:3]) + w[3] > 0).astype(float)
        return params.mlp_forward(x, params.unpack(np.array(w), 3, hidden))[1]

    from wardspan.operators.prepare import sample_rows

    base = predict(sample_rows(rows, 50).toPandas()[X].to_numpy()).mean()
    target = pd.Series(predict(DATA[X].to_numpy()), index=DATA.encounter_id)[:30] - base
    assert np.allclose(phi.groupby("encounter_id").phi.sum(), target)


@pytest.fixture(scope="module")
def federation(spark):
    sf = "/root/testdata/sf0.01"
    settings = order_settings(match_ratio=3, lr_rounds=2, nn_rounds=2, nn_epochs=5)
    prepared = prepare(encounters(spark, sf), settings)
    return settings, prepared, federate.run_federation(prepared, settings)


def test_result_streams(federation):
    settings, _, run = federation
    history = run.history(settings.lr_rounds).toPandas()
    fitting, outside = [s.name for s in settings.sites if s.fits], [s.name for s in settings.sites if not s.fits]
    for model in ("LR", "NN"):
        part = history[history.model == model]
        shift = 0 if model == "LR" else settings.lr_rounds
        assert (part.iteration == part["round"] + shift).all()
        for variant, split, sites in (("global", "test", fitting), ("global", "validation", fitting), ("personalised", "validation", fitting), ("global", "external", outside), ("global", "central", outside)):
            rows = part[(part.variant == variant) & (part.split == split)]
            assert sorted(zip(rows.site, rows["round"], strict=True)) == sorted((s, r) for s in sites for r in (1, 2)), (model, variant, split)
    inside = history[(history.variant == "global") & history.site.isin(fitting)]
    assert (inside[inside["round"] == 1].p_vs_round1 == 1.0).all()
    assert inside[inside.model == "NN"].p_lr_vs_nn.notna().all() and inside[inside.model == "LR"].p_lr_vs_nn.isna().all()
    assert history[(history.model == "NN") & history.site.isin(outside)].p_lr_vs_nn.notna().all()


def test_outside_thresholds_lag_one_round(federation):
    settings, _, run = federation
    history, cuts = run.history(settings.lr_rounds).toPandas(), run.table("thresholds").toPandas()
    carried = 0.0
    for model in ("LR", "NN"):
        outside = history[(history.model == model) & (history.split == "external")].set_index("round").threshold
        mean = cuts[cuts.model == model].groupby("round").threshold.mean()
        assert math.isclose(outside[1], carried) and math.isclose(outside[2], mean[1])
        carried = mean[mean.index.max()]


def test_average_of_local_fits(federation):
    _, _, run = federation
    table = run.table("params").toPandas()
    for _, part in table.groupby(["model", "round"]):
        local, averaged = part[part.site != "GLOBAL"], part[part.site == "GLOBAL"]
        assert np.allclose(averaged.w.iloc[0], np.average(np.stack(local.w), axis=0, weights=local.n_train))


def test_batched_rounds_equal_single_rounds(federation):
    settings, prepared, run = federation
    averaged = run.params[2]
    second = averaged.where("round = 2")
    applied = federate.calibrate_sites(prepared.rows, "LR", second, settings)
    alone = federate.federated_evaluate(prepared.rows, applied, settings).toPandas()
    together = run.results[0].where("round = 2").toPandas()
    keys = ["site", "split"]
    for column in ("threshold", "auc", "logloss", "tp", "specificity"):
        assert np.allclose(alone.sort_values(keys)[column], together.sort_values(keys)[column])


def test_compare_scores(federation):
    settings, prepared, run = federation
    rows = federate.for_rounds(prepared.rows.where("split = 'validation'"), [2])
    applied = federate.ScoredModel("LR", run.params[2], run.thresholds[0].drop("model"))
    by_score = federate.compare_models(rows, applied.at_round(1), applied, settings, "p", on="score").toPandas()
    assert by_score.p.between(0, 1).all() and len(by_score) == 4


def test_reports(federation):
    settings, _, run = federation
    history = run.history(settings.lr_rounds)
    validation = history.where("split in ('validation', 'external')")
    summary = report.summary_table(validation, ["MIDDLE EAST"]).toPandas()
    assert len(summary) == 4 * 6 + 2 and "MIDDLE EAST LR local" not in set(summary.name)
    curves = report.federation_curves(validation).toPandas()
    assert len(curves) == 5 * 2 and curves[curves.site == "MIDDLE EAST"].lr_personalised_auc.isna().all()
    wide = report.results_by_site(validation.where("variant = 'global'"), [s.name for s in settings.sites]).toPandas()
    assert len(wide) == 4 and "ASIA_p_vs_round1" in wide.columns
    points = run.table("roc").where("split = 'validation'").drop("split")
    compared = report.roc_compare(points).toPandas()
    assert set(compared.stage) == {"first_round", "last_round"}
    assert report.central_eval_table(history, settings.lr_rounds).count() == 4
    top = explain.feature_importance(run.params[2].where("round = 2"), settings.features).toPandas()
    assert len(top) == 8 and top.importance.is_monotonic_decreasing


def test_losses(federation):
    _, _, run = federation
    losses, rows = run.table("losses").toPandas(), run.table("results").where("split = 'validation' and variant = 'global'").toPandas()
    for row in losses.itertuples():
        part = rows[(rows.model == row.model) & (rows["round"] == row.round)]
        assert math.isclose(row.logloss, np.average(part.logloss, weights=part.n))


def test_trace_of_scores_is_deterministic(spark, sf):
    settings = order_settings(lr_rounds=1, match_ratio=2)
    one, two = (
        federate.run_federation(prepare(encounters(spark, sf).repartition(n), settings), settings, ("LR",), False, False) for n in (2, 9)
    )
    a, b = (r.table("params").orderBy("site").toPandas() for r in (one, two))
    assert np.allclose(np.stack(a.w), np.stack(b.w))
