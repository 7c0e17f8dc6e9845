"""Stored models and resumable runs: what is read back equals what was computed, and nothing half-written is used."""

import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan.operators import metrics
from wardspan.plans import bundle, federate
from wardspan.plans.cohorts import prepare
from wardspan.sources.encounters import encounters, order_settings
from wardspan.sources.store import RunStore, settings_from, settings_text
from wardspan.specs import BLOOD_CHEMISTRY, BLOOD_COUNT, BLOOD_GASES, CLOTTING, FEATURE_SETS, VITALS

SETTINGS = order_settings(lr_rounds=3, nn_rounds=1, nn_epochs=2)
ORDER = ["model", "variant", "site", "split", "round"]


@pytest.fixture(scope="module")
def prepared(spark, sf):
    return prepare(encounters(spark, sf), SETTINGS, matched=False)


@pytest.fixture(scope="module")
def run(prepared):
    return federate.run_federation(prepared, SETTINGS)


def same_rows(found, expected, order=ORDER):
    columns = sorted(set(expected.columns) - {"iteration"})
    assert columns == sorted(set(found.columns) - {"iteration"})
    one, two = (df.select(*columns).toPandas().sort_values(order).reset_index(drop=True) for df in (found, expected))
    assert len(one) > 0
    pd.testing.assert_frame_equal(one, two, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_settings_survive_text():
    assert settings_from(settings_text(SETTINGS)) == SETTINGS


@pytest.fixture(scope="module")
def published(prepared, run, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bundles"))
    assert bundle.publish_run(root, prepared, run, SETTINGS) == 1
    return root


def test_a_stored_model_scores_a_site_from_raw_encounters(spark, sf, run, published):
    fresh = spark.newSession()
    stored = bundle.load_bundle(fresh, published)
    assert stored.settings == SETTINGS and stored.rounds("LR") == [1, 2, 3] and stored.rounds("NN") == [1]
    for model in ("LR", "NN"):
        expected = run.table("results").where(F.col("split").isin("external", "central") & (F.col("model") == model))
        found = bundle.evaluate_stored(encounters(fresh, sf), stored, model)
        same_rows(found.drop("p_lr_vs_nn"), expected.drop("p_lr_vs_nn"))


def test_a_stored_model_scores_single_encounters(spark, sf, prepared, run, published):
    stored = bundle.load_bundle(spark, published, 1)
    scored = bundle.score_stored(encounters(spark, sf).drop("label", "admission", "icu"), stored, "LR")
    rows = prepared.rows.where(F.col("split") == "central")
    last = run.final["LR"]
    expected = federate._scored(rows, last, SETTINGS, "q").select("encounter_id", "site", "q")
    both = scored.join(expected, ["encounter_id", "site"]).toPandas()
    assert len(both) == rows.count() <= scored.count()
    assert (both["p"] - both["q"]).abs().max() < 1e-12
    assert ((both["p"] > run.shared["LR"][3]).astype(int) == both["predicted"]).all()


def test_sites_that_the_run_did_not_know(spark, sf, published):
    stored = bundle.load_bundle(spark, published)
    outside = [s for s in SETTINGS.sites if not s.fits]
    renamed = [type(s)(**{**s.__dict__, "name": f"new {s.name}"}) for s in outside]
    rows = encounters(spark, sf)
    for old, new in zip(outside, renamed, strict=True):
        rows = rows.withColumn("site", F.when(F.col("site") == old.name, new.name).otherwise(F.col("site")))
    found = bundle.evaluate_stored(rows, stored, "LR", sites=renamed)
    expected = bundle.evaluate_stored(encounters(spark, sf), stored, "LR").withColumn("site", F.concat(F.lit("new "), "site"))
    same_rows(found, expected)
    with pytest.raises(ValueError):
        bundle.evaluate_stored(rows, stored, "LR", sites=[s for s in SETTINGS.sites if s.fits])


def test_half_written_and_altered_bundles_are_refused(spark, prepared, run, published, tmp_path):
    root = str(tmp_path / "bundles")
    shutil.copytree(published, root)
    assert bundle.publish_run(root, prepared, run, SETTINGS) == 2
    os.rename(f"{root}/version-000002/manifest.json", f"{root}/version-000002/manifest.lost")
    assert bundle.versions(spark, root) == [1] and bundle.load_bundle(spark, root).version == 1
    with pytest.raises(ValueError, match="never finished"):
        bundle.load_bundle(spark, root, 2)
    assert bundle.publish_run(root, prepared, run, SETTINGS) == 3  # a claimed number is not used again
    changed = [f"{root}/version-000003/params/{f}" for f in os.listdir(f"{root}/version-000003/params") if f.startswith("part-")]
    for f in changed:
        shutil.copy(f, f"{f[:-8]}-twice.parquet")
    with pytest.raises(ValueError, match="params"):
        bundle.load_bundle(spark, root)
    with pytest.raises(ValueError, match="no published version"):
        bundle.load_bundle(spark, str(tmp_path / "nowhere"))


def test_a_stopped_run_goes_on_after_its_last_whole_round(spark, prepared, run, tmp_path, monkeypatch):
    root, fit, fitted = str(tmp_path / "run"), federate.local_fit, []

    def breaks_in_round_3(rows, model, start, settings):
        (round_no,) = {r for _, r in start} if len({r for _, r in start}) == 1 else {0}
        fitted.append((model, round_no))
        if len(fitted) == 3:
            raise RuntimeError("lost")
        return fit(rows, model, start, settings)

    monkeypatch.setattr(federate, "local_fit", breaks_in_round_3)
    with pytest.raises(RuntimeError, match="lost"):
        federate.run_federation(prepared, SETTINGS, store=RunStore(spark, root, SETTINGS))
    assert RunStore(spark, root, SETTINGS).done("params", "LR", "training") == {1, 2}
    resumed = federate.run_federation(prepared, SETTINGS, store=RunStore(spark, root, SETTINGS))
    assert ("LR", 1) not in fitted[3:] and fitted[3] == ("LR", 3)
    same_rows(resumed.table("results"), run.table("results"))
    stored = RunStore(spark, root, SETTINGS).read("results").drop("part")
    same_rows(stored.select(*run.table("results").columns), run.table("results"))
    before = len(fitted)
    again = federate.run_federation(prepared, SETTINGS, store=RunStore(spark, root, SETTINGS))
    assert len(fitted) == before  # every round was there
    same_rows(again.table("roc").drop("part"), run.table("roc"), ["model", "site", "split", "round", "idx"])
    assert len(os.listdir(f"{root}/sites")) == sum(2 if s.fits else 1 for s in SETTINGS.sites)


def test_a_run_folder_keeps_to_its_settings(spark, tmp_path):
    root = str(tmp_path / "run")
    RunStore(spark, root, SETTINGS)
    RunStore(spark, root, order_settings(lr_rounds=9, nn_rounds=1, nn_epochs=2))
    with pytest.raises(ValueError, match="nn_epochs"):
        RunStore(spark, root, order_settings(lr_rounds=3, nn_rounds=1, nn_epochs=3))


def test_a_repeated_round_replaces_itself_only(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "run"), SETTINGS)
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.5)], "round int, v double")
    store.write("results", rows, "LR", "inside", [1, 2])
    store.write("results", rows.where("round = 1"), "LR", "outside", [1])
    store.write("results", rows.where("v = 2.5").withColumn("v", F.lit(9.0)), "LR", "inside", [2])
    found = {tuple(r) for r in store.read("results").select("part", "round", "v").collect()}
    assert found == {("inside", 1, 1.0), ("inside", 2, 9.0), ("outside", 1, 1.0)}
    assert store.done("results", "LR", "inside") == {1, 2} and store.done("results", "NN", "inside") == set()
    # files without a mark do not count
    store.write("results", rows.where("round = 1"), "NN", "inside", [])
    built = store.rounds("results", "NN", "inside", [1], lambda r: rows.where("round = 1").withColumn("v", F.lit(7.0)))
    assert [r["v"] for r in built.collect()] == [7.0]


def test_groups_without_a_threshold_have_no_cells(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.9), ("b", 0, 0.1)], "site string, label int, p double")
    thresholds = spark.createDataFrame([("a", 0.5), ("b", None)], "site string, threshold double")
    cells = ["tp", "fp", "fn", "tn", "sensitivity", "specificity", "accuracy", "precision", "npv", "f1"]
    for found in (metrics.evaluate_model(rows, thresholds, ["site"]), metrics.confusion(rows.join(thresholds, "site"), ["site"])):
        by_site = {r["site"]: r for r in found.collect()}
        assert [by_site["b"][c] for c in cells] == [None] * len(cells)
        assert [by_site["a"][c] for c in cells[:4]] == [1, 0, 0, 1]


def test_feature_sets_keep_the_published_order():
    wide, largest = FEATURE_SETS["Bloods & Vitals"], FEATURE_SETS["Bloods & Blood_Gas & Vitals"]
    assert (len(FEATURE_SETS["OLO & Vitals"]), len(wide), len(largest)) == (17, 27, 41)
    assert set(wide) == {*BLOOD_COUNT, *BLOOD_CHEMISTRY, *VITALS} and set(largest) == {*wide, *CLOTTING, *BLOOD_GASES}
    assert wide[18:20] == ["blood_white_cells", "blood_egfr"] and largest[22] == "gas_base_excess" and largest[33] == "gas_po2"
