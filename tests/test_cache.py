"""Prepared cohorts are reused only if settings, code and input files are the same."""

import os
import shutil

import pytest

from wardspan.plans import cohorts
from wardspan.sources import tables
from wardspan.sources.encounters import encounters, order_settings

SETTINGS = order_settings()


@pytest.fixture
def inputs(sf, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        shutil.copy(f"{sf}/{name}.parquet", folder)
    return str(folder)


def content(prepared):
    return [sorted(map(repr, t.collect())) for t in (prepared.rows, prepared.stats.select("site", "feature", "median", "min", "max"), prepared.pooled)]


def test_hits_misses_and_changed_inputs(spark, inputs, monkeypatch):
    calls, real = [], cohorts._prepare
    monkeypatch.setattr(cohorts, "_prepare", lambda *given: calls.append(given) or real(*given))
    first = cohorts.prepare(encounters(spark, inputs), SETTINGS, matched=False, reuse=True)
    again = cohorts.prepare(encounters(spark, inputs), SETTINGS, matched=False, reuse=True)
    assert len(calls) == 1 and content(again) == content(first) and again.n_rows == first.n_rows
    assert content(cohorts.prepare(encounters(spark, inputs), SETTINGS, matched=False)) == content(first)
    assert len(calls) == 2  # nothing is reused unless asked for
    cohorts.prepare(encounters(spark, inputs), order_settings(seed=1), matched=False, reuse=True)
    assert len(calls) == 3
    os.utime(f"{inputs}/orders.parquet", (1, 1))
    cohorts.prepare(encounters(spark, inputs), SETTINGS, matched=False, reuse=True)
    assert len(calls) == 4
    monkeypatch.setattr(tables, "code_version", lambda: "other")
    cohorts.prepare(encounters(spark, inputs), SETTINGS, matched=False, reuse=True)
    assert len(calls) == 5


def test_unfinished_tables_and_local_rows_are_not_reused(spark, tmp_path):
    rows, built = spark.range(3), []

    def build():
        built.append(1)
        return {"cohort": rows.selectExpr("id", "'a' AS site"), "pooled": rows}

    root = str(tmp_path / "cache")
    assert tables.cached_tables(spark, root, "k", build)["cohort"].columns == ["id", "site"]
    assert tables.cached_tables(spark, root, "k", build)["cohort"].count() == 3 and len(built) == 1
    os.remove(f"{root}/k/whole.json")
    assert tables.cached_tables(spark, root, "k", build)["pooled"].count() == 3 and len(built) == 2
    assert tables.cache_key(spark.createDataFrame([(1,)], "x int")) is None
    assert tables.cached_tables(spark, root, None, build)["pooled"].count() == 3 and len(built) == 3


def test_prepared_rows_lie_in_folders_per_split(spark, sf):
    rows = cohorts.prepare(encounters(spark, sf), SETTINGS, matched=False).rows
    plan = rows.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and rows.columns[:4] == ["encounter_id", "site", "split", "label"]
