"""From CSV extracts to metric rows, with the ledger and the quarantine."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardspan import session
from wardspan.functions.text import require_numeric, strip_censor
from wardspan.operators.harmonise import ARRIVAL_FORMATS, parse_arrival
from wardspan.plans import extracts
from wardspan.plans.cohorts import prepare
from wardspan.plans.extracts import Extract, harmonise_extracts
from wardspan.plans.federate import run_federation
from wardspan.specs import DISPLAY_NAMES, RunSettings, SiteSpec

FEATURES = ("vital_heart_rate", "blood_alt")


def common_rows(first, n):
    rows = []
    for k in range(first, first + n):
        ill = k % 3 == 0
        row = dict.fromkeys(DISPLAY_NAMES.values(), "1") | {"ClusterID": f"c{k}", "ArrivalDateTime": f"{3 + k % 20}/02/{2020 if ill else 2019} 10:00"}
        rows.append(row | {"Covid-19 Positive": int(ill), "Vital_Sign Heart Rate": 60 + k % 7 + 20 * ill, "Blood_Test ALT": k % 11})
    return rows


def write(tmp_path, name, rows, more=""):
    path = tmp_path / f"{name}.csv"
    pd.DataFrame(rows).to_csv(path, index=False)
    path.write_text(path.read_text() + more)
    return str(path)


def test_from_files_to_metric_rows(spark, tmp_path):
    rows = common_rows(0, 120)
    rows[1]["ArrivalDateTime"] = "yesterday"
    rows[2]["Vital_Sign Delivery device used"] = "tent"
    rows[4]["ArrivalDateTime"] = None
    one = write(tmp_path, "one", rows, "broken,line\n")
    two = write(tmp_path, "two", common_rows(200, 90))
    found = harmonise_extracts(spark, [Extract("A", "common", one), Extract("B", "common", two)])
    ledger = {(r.site, r.check, r.detail): r.n for r in found.ledger.collect()}
    assert ledger == {
        ("A", "sound", None): 119, ("A", "malformed line", None): 1, ("A", "unreadable date", None): 1, ("A", "unmapped device", "tent"): 1, ("B", "sound", None): 90,
    }
    aside = {r.line_state: r.line for r in found.quarantine.collect()}
    assert aside["malformed line"] == "broken,line" and "yesterday" in aside["unreadable date"] and len(aside) == 2
    encounters = found.encounters.persist()
    assert encounters.count() == 209 and encounters.where("arrival_ts IS NULL").count() == 1
    sites = tuple(SiteSpec(name, train_until="2020-12-31", validate_from="2020-02-01") for name in "AB")
    settings = RunSettings(features=FEATURES, sites=sites, lr_rounds=1, control_before="2019-12-01")
    run = run_federation(prepare(encounters, settings, matched=False), settings, models=("LR",), with_personalised=False, with_roc=False)
    metrics = run.table("results").where("split = 'test'").collect()
    assert {r.site for r in metrics} == {"A", "B"} and all(r.auc > 0.9 for r in metrics)


def test_ids_that_do_not_match_a_correction(spark):
    encounters = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "epis_sg2 string")
    correction = spark.createDataFrame([("2", "1"), ("9", "0"), ("9", "0"), (None, "1")], "epis_sg2 string, pcr_result48 string")
    gaps = {r.check: r.n for r in extracts.correction_gaps(encounters, correction).collect()}
    assert gaps == {extracts.UNKNOWN_ID: 1, extracts.UNCORRECTED: 1}


def test_what_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no extracts"):
        harmonise_extracts(spark, [])
    path = write(tmp_path, "odd", [{"a": 1}])
    with pytest.raises(ValueError, match="kind other"):
        harmonise_extracts(spark, [Extract("A", "other", path)])
    with pytest.raises(ValueError, match="no column period"):
        harmonise_extracts(spark, [Extract("A", "period", path)])


def test_formats_are_tried_only_where_they_may_fit(spark):
    texts = ["2020-1-2 3:4", "2020-01-02T03:04:05", "2020-01-02t03:04", "2020-01-02", " 2020-01-02", "2020-01-02 10:00:00.5", "+2020-01-02", "1/2/2020", "31/12/2020 10:00:00.123456"]
    texts += ["30/02/2020 10:00", "1/2-2020", "2020-01-02 10", "12/2020", "10:00", "1/2/2020T10:00", "soon", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in ARRIVAL_FORMATS])
    found = df.select("t", parse_arrival(F.col("t")).alias("now"), plain.alias("plain"))
    assert all(r.now == r.plain for r in found.collect()) and found.where("now IS NOT NULL").count() >= 6
    tried = found.select("now")._jdf.queryExecution().optimizedPlan().toString()
    assert tried.count("Contains(") >= 2 * len(ARRIVAL_FORMATS)


def test_wide_rows_are_written_by_methods_that_get_compiled(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    given = spark.conf.get(name, None)

    def watched(df, stage, by=()):
        seen.append((stage, spark.conf.get(name, None)))
        return session.write_stage(df, stage, by)

    monkeypatch.setattr(extracts, "write_stage", watched)
    harmonise_extracts(spark, [Extract("A", "common", write(tmp_path, "one", common_rows(0, 3)))])
    assert dict(seen)["extract"] == dict(seen)["harmonised"] == session.COMPILED_METHOD_BYTES
    with pytest.raises(KeyError), session.compiled_methods(spark):
        raise KeyError
    assert spark.conf.get(name, None) == given


def test_censored_and_strict_numbers(spark):
    df = spark.createDataFrame([("<5", " 7 "), ("6>", ""), ("8", None), (None, "NaN")], "a string, b string")
    assert [r.a for r in strip_censor(df).collect()] == ["5", "6", "8", None]
    assert [r.a for r in require_numeric(strip_censor(df), ["a"]).collect()] == [5.0, 6.0, 8.0, None]
    assert [r.b for r in require_numeric(df.where("b is null or b != 'NaN'"), ["b"]).collect()] == [7.0, None, None]
    for bad in ("x", "NaN"):
        with pytest.raises(Exception, match="not a number"):
            require_numeric(spark.createDataFrame([(bad,)], "b string"), ["b"]).collect()
