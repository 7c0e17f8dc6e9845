"""Statistics, imputation, scaling, splitting, filters."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardspan.functions.text import coerce_numeric, format_auc_ci, format_percent_ci, parse_ci, require_numeric, strip_censor
from wardspan.operators import filters, prepare
from wardspan.plans import cohorts
from wardspan.sources.encounters import encounters, order_settings
from wardspan.specs import FEATURE_SETS, RunSettings, SiteSpec

RNG = np.random.default_rng(3)


def values():
    n = 3_000
    data = pd.DataFrame(
        {
            "site": RNG.choice(["A", "B", "C"], n, p=[0.7, 0.25, 0.05]),
            "smooth": RNG.normal(size=n),
            "ties": RNG.choice([0.0, 1.0, 1.0, 1.0, 7.0], n),
            "ends": np.where(RNG.random(n) < 0.5, -1.0, np.where(RNG.random(n) < 0.98, 5.0, RNG.random(n))),
            "flat": 4.0,
            "long_tail": np.exp(RNG.normal(0, 4, n)),
        }
    )
    data.loc[RNG.random(n) < 0.1, "smooth"] = None
    return data


DATA = values()
FEATURES = ["smooth", "ties", "ends", "flat", "long_tail"]


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame(DATA.astype(object).where(DATA.notna(), None), ", ".join(["site string", *[f"{f} double" for f in FEATURES]]))
    return frame.repartition(5)


@pytest.mark.parametrize("whole_rows,limit", [(10_000, 1_000_000), (10, 1_000_000), (10, 4), (10, 1), (1_000, 0)])
def test_exact_medians(rows, whole_rows, limit):
    stats = prepare.site_stats(rows, FEATURES, whole_rows=whole_rows, median_values=limit).toPandas().set_index(["site", "feature"])
    for site, group in DATA.groupby("site"):
        for f in FEATURES:
            row = stats.loc[(site, f)]
            assert math.isclose(row["median"], group[f].median(), rel_tol=1e-12, abs_tol=1e-12), (site, f)
            assert row["min"] == group[f].min() and row["max"] == group[f].max() and row["n_nonnull"] == group[f].count()
            assert math.isclose(row["mean"], group[f].mean(), rel_tol=1e-9)


def test_bracket_that_misses_the_median(rows):
    overview = prepare._overview(rows, ["smooth", "ties"], "site").withColumn("near", F.array(F.col("max"), F.col("max")))
    found = prepare.exact_medians(rows, overview, ["smooth", "ties"], "site", 10).toPandas().set_index(["site", "feature"])
    for site, group in DATA.groupby("site"):
        for f in ("smooth", "ties"):
            assert math.isclose(found.loc[(site, f), "median"], group[f].median(), abs_tol=1e-12)


def test_feature_without_values(spark):
    rows = spark.createDataFrame([("A", None, 1.0), ("A", None, 3.0)], "site string, empty double, x double")
    stats = {r.feature: r for r in prepare.site_stats(rows, ["empty", "x"]).collect()}
    assert stats["empty"]["median"] is None and stats["empty"].n_nonnull == 0 and stats["x"]["median"] == 2.0


def test_scaling_keeps_constants_and_does_not_clip(spark):
    rows = spark.createDataFrame([("A", 2.0, 4.0), ("A", 6.0, 4.0)], "site string, x double, c double")
    stats = prepare.site_stats(rows, ["x", "c"])
    other = spark.createDataFrame([("A", 10.0, 5.0)], "site string, x double, c double")
    assert prepare.minmax_scale(other, stats, ["x", "c"]).first()[1:] == (2.0, 1.0)


def test_impute_and_scale_equals_two_steps(rows):
    stats = prepare.site_stats(rows, FEATURES)
    once = prepare.impute_and_scale(rows, stats, FEATURES).toPandas().sort_values(["site", *FEATURES]).reset_index(drop=True)
    twice = prepare.minmax_scale(prepare.impute_site(rows, stats, FEATURES), stats, FEATURES)
    pd.testing.assert_frame_equal(once, twice.toPandas().sort_values(["site", *FEATURES]).reset_index(drop=True)[once.columns])


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(5_000).withColumnRenamed("id", "encounter_id")
    results = [
        prepare.split_train_test(ids.repartition(n)).orderBy("encounter_id").toPandas().split for n in (1, 7, 40)
    ]
    assert results[0].equals(results[1]) and results[1].equals(results[2])
    assert abs((results[0] == "test").mean() - 51 / 256) < 0.02


def test_sample_and_shuffle(spark):
    ids = spark.range(500).withColumnRenamed("id", "encounter_id")
    one, many = prepare.sample_rows(ids, 30), prepare.sample_rows(ids.repartition(9), 30)
    assert {r[0] for r in one.collect()} == {r[0] for r in many.collect()} and one.count() == 30
    shuffled = prepare.shuffle_rows(ids).toPandas()
    assert sorted(shuffled.position) == list(range(500)) and list(shuffled.sort_values("position").encounter_id) != list(range(500))


def test_windows_at_midnight(spark):
    rows = spark.createDataFrame([("2020-10-29 00:00:00",), ("2020-10-29 00:00:01",), ("2018-12-01 00:00:00",)], "t string")
    rows = rows.select(F.col("t").cast("timestamp").alias("arrival_ts"))
    assert filters.filter_window(rows, "2018-12-01", "2020-10-29").count() == 2
    before, after = filters.split_eras(rows, "2020-10-29")
    assert before.count() == 1 and after.count() == 1


def test_filters_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderdate", "arrival_ts")
    plan = filters.filter_window(rows, "1996-01-01", "1997-01-01").select("o_orderkey")._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "PushedFilters" in line][-1]
    assert "GreaterThanOrEqual(o_orderdate" in scan and "o_totalprice" not in scan


def test_text_cleaning(spark):
    rows = spark.createDataFrame([("<5",), (">90",), ("n/a",), (None,), (" 7.5 ",), ("NaN",)], "lab string")
    cleaned = [r.lab for r in coerce_numeric(strip_censor(rows), ["lab"]).collect()]
    assert cleaned == [5.0, 90.0, None, None, 7.5, None]


def test_strict_cast_stops(spark):
    good = spark.createDataFrame([("5",), (None,), ("",)], "lab string")
    assert [r.lab for r in require_numeric(good, ["lab"]).collect()] == [5.0, None, None]
    with pytest.raises(PySparkException, match="not a number"):
        require_numeric(spark.createDataFrame([("5x",)], "lab string"), ["lab"]).collect()


def test_interval_texts(spark):
    row = spark.createDataFrame([(0.85, 0.80149, 0.8925, 0.9, 0.88, 0.92)], "p double, l double, h double, a double, b double, c double")
    percent, auc = format_percent_ci(F.col("p"), F.col("l"), F.col("h")), format_auc_ci(F.col("a"), F.col("b"), F.col("c"))
    texts = row.select(percent.alias("p"), auc.alias("a")).first()
    assert texts.p == "85.0% (80.1 - 89.3)" and texts.a == "0.9 (0.88 - 0.92)"
    back = spark.createDataFrame([(texts.a,), (texts.p,), ("0.5",), (None,)], "t string").select(*[c.alias(n) for n, c in zip("xyz", parse_ci(F.col("t")), strict=True)])
    assert [tuple(r) for r in back.collect()] == [(0.9, 0.88, 0.92), (85.0, 80.1, 89.3), (None,) * 3, (None,) * 3]


def test_feature_sets():
    assert [len(FEATURE_SETS[n]) for n in ("OLO & Vitals", "Bloods & Vitals", "Bloods & Blood_Gas & Vitals")] == [17, 27, 41]
    assert all(len(set(s)) == len(s) for s in FEATURE_SETS.values()) and len(RunSettings().features) == 27


def test_roles_equal_separate_filters(spark, sf):
    rows, settings = encounters(spark, sf), order_settings()
    roles = cohorts.assign_roles(rows, settings)
    training = cohorts.training_rows(rows, settings)
    ids = lambda df: {r.encounter_id for r in df.select("encounter_id").collect()}
    assert ids(roles.where("role = 'case'")) == ids(filters.case_cohort(training))
    assert ids(roles.where("role = 'control'")) == ids(filters.control_cohort(training, settings.control_before))
    for split, fits in (("validation", True), ("external", False)):
        assert ids(roles.where(F.array_contains("later", split))) == ids(cohorts.validation_rows(rows, settings, fits))


def test_prepared_table(spark, sf):
    settings = order_settings(match_ratio=2)
    prepared = cohorts.prepare(encounters(spark, sf), settings)
    counts = {(r.site, r.split): r.n_rows for r in filters.cohort_counts(prepared.rows).collect()}
    assert counts[("EUROPE", "validation")] == counts[("EUROPE", "test")]
    assert {s for _, s in counts} == {"train", "test", "validation", "external", "central"}
    inside = prepared.rows.where("split in ('train', 'test')")
    low, high = inside.agg(F.min("sum_qty"), F.max("sum_qty")).first()
    assert (low, high) == (0.0, 1.0) and prepared.n_rows == sum(counts.values())
    assert prepared.rows.where(" or ".join(f"{f} is null" for f in settings.features)).isEmpty()
    unmatched = cohorts.prepare(encounters(spark, sf), settings, matched=False)
    assert unmatched.n_rows > prepared.n_rows


def test_without_external_sites(spark, sf):
    sites = (SiteSpec("ASIA", train_until="2000-06-30", validate_from="2000-07-01"),)
    prepared = cohorts.prepare(encounters(spark, sf), order_settings(sites=sites), matched=False)
    assert {r.split for r in prepared.rows.select("split").distinct().collect()} == {"train", "test", "validation"}
