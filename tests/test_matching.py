"""Control matching against the sequential procedure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.operators.matching import HASH_SPAN, STRATA, match_candidates, match_controls, preference

SCHEMA = "site string, gender string, ethnicity string, age double, encounter_id bigint"


def people(rng, n, first_id, ages):
    return pd.DataFrame(
        {
            "site": rng.choice(["A", "B"], n, p=[0.8, 0.2]),
            "gender": rng.choice(["F", "M", None], n, p=[0.6, 0.35, 0.05]),
            "ethnicity": "White",
            "age": rng.choice(ages, n),
            "encounter_id": rng.permutation(n) + first_id,
        }
    )


def frames(spark, seed, n_cases, n_controls, ages):
    rng = np.random.default_rng(seed)
    cases, controls = people(rng, n_cases, 0, ages), people(rng, n_controls, 100_000, ages)
    return spark.createDataFrame(cases, SCHEMA), spark.createDataFrame(controls, SCHEMA)


def sequential(cases, controls, k, seed=0, band=4.0):
    """Cases in id order take the first k unused controls of their class's shuffled list."""
    left = cases.select(*STRATA, F.col("age").alias("case_age"), F.col("encounter_id").alias("case_id"))
    right = controls.select(*STRATA, "age", F.col("encounter_id").alias("control_id"))
    pairs = left.join(right, list(STRATA)).where((F.col("age") < F.col("case_age") + band) & (F.col("age") > F.col("case_age") - band))
    pairs = pairs.withColumn("pref", preference(STRATA, seed))
    lists = pairs.toPandas().sort_values(["case_id", "pref"]).groupby("case_id").control_id.apply(list)
    used, result = set(), set()
    for case, candidates in lists.items():
        free = [c for c in candidates if c not in used][:k]
        used.update(free)
        result.update((c, case) for c in free)
    return result


def found(pairs):
    return {(r.control_id, r.case_id) for r in pairs.collect()}


WHOLE = np.arange(30.0, 52.0)


@pytest.mark.parametrize(
    "seed,n_cases,n_controls,k,ages",
    [
        (1, 60, 300, 3, WHOLE),  # competition
        (2, 40, 60, 5, WHOLE),  # too few controls
        (3, 15, 1_500, 2, WHOLE),  # more controls than anyone reaches: lists are shortened
        (4, 50, 200, 4, np.arange(30.0, 40.0, 0.25)),  # fractional ages
        (5, 40, 200, 10, np.array([40.0])),  # one class
    ],
)
def test_equals_sequential(spark, seed, n_cases, n_controls, k, ages):
    cases, controls = frames(spark, seed, n_cases, n_controls, ages)
    assert found(match_controls(cases, controls, k)) == sequential(cases, controls, k)


def test_ranges_and_partitions_do_not_matter(spark):
    cases, controls = frames(spark, 6, 50, 300, WHOLE)
    expected = found(match_controls(cases, controls, 3))
    assert expected == found(match_controls(cases.repartition(7), controls.repartition(13), 3, rows_per_bucket=40))


def test_lists_cut_too_short_are_written_whole(spark, monkeypatch):
    """Shares that keep next to nothing make every list fall short of its reach."""
    from wardspan.operators import matching

    cases, controls = frames(spark, 3, 15, 1_500, WHOLE)
    whole_classes = matching._classes
    monkeypatch.setattr(matching, "_classes", lambda *a: whole_classes(*a).withColumn("share", F.col("share") * 0 + 0.001))
    assert found(match_controls(cases, controls, 2)) == sequential(cases, controls, 2)


def test_unreachable_controls_are_not_listed(spark):
    from wardspan.operators import matching

    cases, controls = frames(spark, 3, 15, 1_500, np.array([40.0, 41.0]))
    cases, controls = (f.na.drop() for f in (cases, controls))
    right = controls.withColumnRenamed("encounter_id", "control_id")
    classes = matching._classes(cases, right, list(STRATA), "age", 2, 4.0)
    assert matching._lists(classes, right, list(STRATA), ["site"], "age", 4.0, 0).count() < 0.5 * controls.count() * 2
    assert classes.where("share is not null").count() > 0


def test_band_is_strict_and_missing_values_never_match(spark):
    cases = spark.createDataFrame([("A", "F", "White", 40.0, 1), ("A", None, "White", 40.0, 2), ("A", "F", "White", None, 3)], SCHEMA)
    ages = [36.0, 36.01, 43.99, 44.0, None]
    controls = spark.createDataFrame([("A", "F", "White", a, 10 + i) for i, a in enumerate(ages)] + [("A", None, "White", 40.0, 20)], SCHEMA)
    assert found(match_controls(cases, controls, 10)) == {(11, 1), (12, 1)}
    counts = {r.case_id: r.n_candidates for r in match_candidates(cases, controls).collect()}
    assert counts == {1: 2, 2: 0, 3: 0}


def test_no_case_or_no_control(spark):
    cases, controls = frames(spark, 7, 5, 5, WHOLE)
    assert match_controls(cases.limit(0), controls, 2).isEmpty()
    assert match_controls(cases, controls.limit(0), 2).isEmpty()


def test_preferences_are_spread_over_the_hash_range(spark):
    share = spark.range(20_000).select(F.lit(40.0).alias("case_age"), F.col("id").alias("control_id")).select((preference([], 0) / F.lit(HASH_SPAN)).alias("u")).agg(F.avg("u")).first()[0]
    assert abs(share - 0.5) < 0.02


def test_ids_belong_to_their_site(spark):
    """The same ids occur at two sites; text ids give as many pairs."""
    cases = spark.createDataFrame([(s, "F", "White", 40.0, i) for s in "AB" for i in (1, 2)], SCHEMA)
    controls = spark.createDataFrame([(s, "F", "White", 41.0, 100 + i) for s in "AB" for i in range(6)], SCHEMA)
    pairs = {(r.site, r.control_id, r.case_id) for r in match_controls(cases, controls, 2).collect()}
    assert len(pairs) == 8 and {(s, c) for s, _, c in pairs} == {(s, c) for s in "AB" for c in (1, 2)}
    text = [f.withColumn("encounter_id", F.concat(F.lit("x"), F.col("encounter_id").cast("string"))) for f in (cases, controls)]
    named = match_controls(*text, 2).collect()
    assert len(named) == 8 and len({(r.site, r.control_id) for r in named}) == 8


@pytest.mark.parametrize("rows_per_bucket,text", [(2_000_000, False), (160, False), (160, True)])
def test_cases_choose_in_blocks(spark, monkeypatch, rows_per_bucket, text):
    """Whole strata choose without a pass over all lists; where blocks share controls, few passes settle their claims."""
    from wardspan.operators import matching

    passes, n_blocks = [], []
    observe, blocks_of = matching.Observation, matching._blocks
    monkeypatch.setattr(matching, "Observation", lambda: passes.append(1) or observe())

    def blocks(*given):
        made = blocks_of(*given)
        n_blocks.append(made.select("block").distinct().count())
        return made

    monkeypatch.setattr(matching, "_blocks", blocks)
    cases, controls = frames(spark, 8, 120, 400, np.arange(30.0, 60.0))
    pairs = found(match_controls(cases, controls, 3, rows_per_bucket=rows_per_bucket))
    assert pairs == sequential(cases, controls, 3)
    assert (n_blocks[0] == 4 and not passes) if rows_per_bucket > 1000 else (n_blocks[0] > 6 and 2 <= len(passes) < 12)
    if text:
        named = [f.withColumn("encounter_id", F.concat(F.lit("x"), F.col("encounter_id").cast("string"))) for f in (cases, controls)]
        parted, whole = (found(match_controls(*named, 3, rows_per_bucket=n)) for n in (rows_per_bucket, 2_000_000))
        assert parted == whole and len(whole) > 100


def test_repeated_and_missing_ids_choose_alike_in_blocks_and_ranges(spark, monkeypatch):
    """A control that comes twice goes twice to one case; without ids cases come first, as in the passes over sorted ranges."""
    from wardspan.operators import matching

    cases, controls = frames(spark, 9, 40, 160, np.arange(30.0, 42.0))
    cases, controls = (f.unionByName(f.where("encounter_id % 3 = 0")).withColumn("encounter_id", F.expr("nullif(encounter_id, 4)")) for f in (cases, controls))
    lists = [sorted(map(str, match_controls(cases, controls, 3, rows_per_bucket=n).collect())) for n in (2_000_000, 100)]
    monkeypatch.setattr(matching, "_blocks", lambda *given: None)
    assert lists == 2 * [sorted(map(str, match_controls(cases, controls, 3).collect()))]
