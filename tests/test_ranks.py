"""Rank statistics against brute force, with and without split ranges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.functions.stats import exact_sign_p, wilson_bounds
from wardspan.operators import curves, metrics
from wardspan.operators.scale import lookup_join, range_splits, running_totals

RNG = np.random.default_rng(7)


def frame(n=400, digits=2):
    """Two sites with tied scores; ids are unique."""
    y = RNG.integers(0, 2, n)
    p = np.clip(np.round(RNG.normal(0.4 + 0.2 * y, 0.25), digits), 0, 1)
    q = np.clip(np.round(0.5 * p + 0.5 * RNG.random(n), digits), 0, 1)
    w = RNG.integers(1, 4, n).astype(float)
    site = np.where(np.arange(n) % 3 == 0, "A", "B")
    return pd.DataFrame({"encounter_id": np.arange(n), "site": site, "label": y, "p": p, "q": q, "weight": w})


DATA = frame()
SPLITS = [None, (0.2, 0.4, 0.5, 0.61, 0.9)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(DATA).repartition(7)


def kernel(y, p):
    x, z = p[y == 1][:, None], p[y == 0][None, :]
    return (x > z) + 0.5 * (x == z)


def brute_delong(y, *ps):
    wins = np.array([kernel(y, p).mean(axis=1) for p in ps])
    losses = np.array([kernel(y, p).mean(axis=0) for p in ps])
    cov = np.cov(wins) / wins.shape[1] + np.cov(losses) / losses.shape[1]
    return wins.mean(axis=1), np.atleast_2d(cov)


def parts():
    return [(s, g.label.to_numpy(), g) for s, g in DATA.groupby("site")]


@pytest.mark.parametrize("splits", SPLITS)
def test_midrank(scores, splits):
    found = curves.midrank(scores, ["site"], splits=splits).toPandas().set_index("encounter_id")
    expected = DATA.groupby("site").p.rank(method="average")
    assert np.allclose(found.midrank.sort_index(), expected.set_axis(DATA.encounter_id))


@pytest.mark.parametrize("splits", SPLITS)
def test_delong_auc(scores, splits):
    found = curves.delong_auc(scores, ["site"], splits=splits).toPandas().set_index("site")
    for site, y, g in parts():
        auc, cov = brute_delong(y, g.p.to_numpy())
        assert math.isclose(found.auc[site], auc[0], rel_tol=1e-12)
        assert math.isclose(found.auc_var[site], cov[0, 0], rel_tol=1e-9)


@pytest.mark.parametrize("splits", SPLITS)
def test_delong_test(scores, splits):
    found = curves.delong_test(scores, ["site"], "p", "q", splits=splits).toPandas().set_index("site")
    for site, y, g in parts():
        auc, cov = brute_delong(y, g.p.to_numpy(), g.q.to_numpy())
        z = abs(auc[0] - auc[1]) / math.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
        assert math.isclose(found.z[site], z, rel_tol=1e-8)
        assert math.isclose(found.p_value[site], math.erfc(z / math.sqrt(2)), rel_tol=1e-6)


def test_identical_predictions(scores):
    row = curves.delong_test(scores.withColumn("r", F.col("p")), ["site"], "p", "r").first()
    assert row.identical and row.z is None and row.p_value == 1.0


def test_single_class_has_no_auc(scores):
    row = curves.delong_auc(scores.where("label = 1"), ["site"]).first()
    assert row.auc is None and row.auc_var is None
    assert not curves.ground_truth(scores.where("label = 1"), ["site"]).first().valid


def test_all_scores_tied(scores):
    row = curves.delong_auc(scores.withColumn("p", F.lit(0.5)), ["site"]).first()
    assert row.auc == 0.5 and row.auc_var == 0.0


@pytest.mark.parametrize("splits", SPLITS)
def test_roc_curve(scores, splits):
    found = curves.roc_curve(scores, ["site"], splits=splits).toPandas()
    for site, y, g in parts():
        curve = found[found.site == site].sort_values("idx")
        assert list(curve.idx) == list(range(len(curve)))
        cuts = sorted(g.p.unique(), reverse=True)
        points = [(g.p[y == 0].ge(t).mean(), g.p[y == 1].ge(t).mean()) for t in cuts]
        n = np.array([(((y == 0) & (g.p == t)).sum(), ((y == 1) & (g.p == t)).sum()) for t in cuts])
        kept = [i for i in range(len(cuts)) if i in (0, len(cuts) - 1) or (n[i] != n[i + 1]).any()]
        assert np.allclose(curve[["fpr", "tpr"]].to_numpy()[1:], [points[i] for i in kept])
        assert tuple(curve[["fpr", "tpr"]].iloc[-1]) == (1.0, 1.0)
        area = np.trapezoid(curve.tpr, curve.fpr)
        assert math.isclose(area, kernel(y, g.p.to_numpy()).mean(), rel_tol=1e-9)


def reference_weighted_ranks(g):
    g = g.sort_values(["p", "encounter_id"])
    return g.weight.cumsum().groupby(g.p).transform("mean").set_axis(g.encounter_id)


@pytest.mark.parametrize("splits,key_splits", [(None, None), ((0.3, 0.5), (57, 190.0, 333))])
def test_weighted(scores, splits, key_splits):
    found = curves.midrank_weighted(scores, ["site"], splits=splits, key_splits=key_splits).toPandas().set_index("encounter_id")
    tested = curves.delong_weighted(scores, ["site"], splits=splits, key_splits=key_splits).toPandas().set_index("site")
    for site, _, g in parts():
        ranks = reference_weighted_ranks(g)
        assert np.allclose(found.midrank.loc[ranks.index], ranks)
        pos, neg = g[g.label == 1], g[g.label == 0]
        gain = ranks.loc[pos.encounter_id] - reference_weighted_ranks(pos).loc[pos.encounter_id]
        loss = ranks.loc[neg.encounter_id] - reference_weighted_ranks(neg).loc[neg.encounter_id]
        w1, w0 = pos.weight.sum(), neg.weight.sum()
        assert math.isclose(tested.auc[site], (pos.weight.to_numpy() * gain.to_numpy()).sum() / (w1 * w0), rel_tol=1e-9)
        variance = np.var(gain / w0, ddof=1) / len(pos) + np.var(1 - loss / w1, ddof=1) / len(neg)
        assert math.isclose(tested.auc_var[site], variance, rel_tol=1e-8)


def test_weight_one_equals_unweighted(scores):
    one = scores.withColumn("weight", F.lit(1.0))
    a = curves.midrank(scores, ["site"]).select("encounter_id", "midrank").toPandas().set_index("encounter_id").sort_index()
    b = curves.midrank_weighted(one, ["site"]).select("encounter_id", "midrank").toPandas().set_index("encounter_id").sort_index()
    assert np.allclose(a, b)


def test_sweep_matches_every_threshold(scores):
    found = metrics.threshold_sweep(scores, ["site"]).toPandas()
    prev = 1 / 11
    for site, y, g in parts():
        swept = found[found.site == site].sort_values("idx")
        assert len(swept) == 500
        assert np.array_equal(swept.threshold, np.linspace(0, 1, 500))
        for row in swept.iloc[::7].itertuples():
            hit = g.p.to_numpy() > row.threshold
            recall, specificity = hit[y == 1].mean(), (~hit)[y == 0].mean()
            assert math.isclose(row.recall, recall, abs_tol=1e-12)
            assert math.isclose(row.specificity, specificity, abs_tol=1e-12)
            bottom = recall * prev + (1 - specificity) * (1 - prev)
            if bottom:
                assert math.isclose(row.precision, recall * prev / bottom, rel_tol=1e-9)
            else:
                assert math.isnan(row.precision)


def test_no_threshold_gives_zero(scores):
    sweep = metrics.threshold_sweep(scores, ["site"])
    row = metrics.best_threshold(sweep, ["site"], "recall", 5.0).first()
    assert row.threshold == 0.0 and not row.found and row.recall is None


def test_scores_on_grid_points(spark):
    grid = np.linspace(0, 1, 500)
    rows = spark.createDataFrame(pd.DataFrame({"p": np.concatenate([grid, np.nextafter(grid, 2)])}))
    cells = rows.withColumn("cell", metrics.thresholds_below("p")).toPandas()
    assert np.array_equal(cells.cell, [(grid < p).sum() for p in cells.p])


def test_confusion_without_predictions(scores):
    row = metrics.confusion(scores.withColumn("threshold", F.lit(2.0)), ["site"]).first()
    assert row.tp == 0 and row.precision == 0.0 and row.sensitivity == 0.0 and row.f1 is None


def test_evaluate_equals_parts(scores, spark):
    cuts = spark.createDataFrame([("A", 0.5), ("B", 0.45)], "site string, threshold double")
    whole = metrics.evaluate_model(scores, cuts, ["site"], splits=(0.3, 0.6)).toPandas().set_index("site").sort_index()
    split = metrics.confusion(scores.join(cuts, "site"), ["site"]).toPandas().set_index("site").sort_index()
    assert np.allclose(whole[split.columns], split)
    bounded = scores.withColumn("p", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01)))
    loss = metrics.log_loss(bounded, ["site"]).toPandas().set_index("site").sort_index()
    again = metrics.evaluate_model(bounded, cuts, ["site"]).toPandas().set_index("site").sort_index()
    assert np.allclose(loss.logloss, again.logloss)


def test_wilson(spark):
    low, high = wilson_bounds("a", "b")
    row = spark.createDataFrame([(8, 10), (0, 0)], "a int, b int").select(low.alias("l"), high.alias("h")).collect()
    assert round(row[0].l, 4) == 0.4902 and round(row[0].h, 4) == 0.9433  # published example for 8 of 10
    assert row[1].l is None and row[1].h is None


def test_exact_sign_p(spark):
    def brute(a, b):
        n, low = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)

    pairs = [(0, 0), (0, 5), (3, 9), (40, 61), (200, 200)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("p", exact_sign_p(F.col("a"), F.col("b")))
    for row in rows.collect():
        assert math.isclose(row.p, brute(row.a, row.b) if row.a + row.b else 1.0, rel_tol=1e-9)
    large = spark.createDataFrame([(499_000, 501_000)], "a bigint, b bigint").select(exact_sign_p("a", "b").alias("p")).first().p
    assert math.isclose(large, math.erfc((2_000 - 1) / 1_000 / math.sqrt(2)), rel_tol=1e-3)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_across_ranges(spark, descending):
    rows = spark.createDataFrame(pd.DataFrame({"g": [1] * 60 + [2] * 40, "x": [*range(60), *range(40)], "v": range(100)})).repartition(5)
    options = {"descending": descending, "next_values": ["v"]}
    plain = running_totals(rows, ["g"], "x", ["v"], **options)
    ranged = running_totals(rows, ["g"], "x", ["v"], splits=[3, 4, 30, 55.5], **options)
    assert sorted(plain.collect()) == sorted(ranged.select(*plain.columns).collect())


def test_range_splits_bound_the_ranges(spark):
    rows = spark.range(10_000).withColumn("x", F.col("id") * F.col("id"))
    splits = range_splits(rows, "x", rows_per_bucket=1_000)
    sizes = np.histogram([i * i for i in range(10_000)], [-1, *splits, 1e9])[0]
    assert sizes.max() < 1_500
    assert range_splits(rows, "x") == [] and range_splits(rows, "x", splits=(1,)) == (1,)


def test_lookup_join_beyond_the_bound(spark):
    big = spark.range(1_000).withColumn("k", F.col("id") % 20)
    small = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    checked, salted = lookup_join(big, small, ["k"]), lookup_join(big, small, ["k"], limit=3, salts=5)
    assert sorted(checked.collect()) == sorted(salted.select(*checked.columns).collect())
    assert "BroadcastHashJoin" in checked._jdf.queryExecution().toString()
