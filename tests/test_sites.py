"""Harmonised extracts from CSV files, corrections, sinks."""

import datetime as dt

import pandas as pd
import pytest

from wardspan.operators.harmonise import device_level, harmonise_ethnicity, unmapped_devices
from wardspan.plans import harmonise_sites as sites
from wardspan.sources import tables
from wardspan.sources.raw import CORRUPT, read_site_csv
from wardspan.specs import (
    DEVICE_TEXT_LEVELS,
    DISPLAY_NAMES,
    DUAL_SITE_COLUMNS,
    DUAL_SITE_DROPPED,
    ETHNICITY_CODES,
    OUTCOME_COLUMN,
    OUTCOME_SITE_COLUMNS,
    PCR_COLUMN,
    PERIOD_SITE_COLUMNS,
    SECOND_ASSAY_COLUMN,
    SEX_COLUMN,
    level_map,
)


def csv(spark, tmp_path, name, rows, columns=None):
    path = str(tmp_path / f"{name}.csv")
    pd.DataFrame(rows).to_csv(path, index=False)
    return read_site_csv(spark, path, columns)


def outcome_row(**changes):
    row = {c: "1" for c in OUTCOME_SITE_COLUMNS}
    row |= {
        "PresentationID (unique identifier)": "p1",
        "PresentationDate": "03/01/2021 10:20",
        "EthnicityCode": "H",
        "AdmissionOxygenDeliveryDevice": None,
        OUTCOME_COLUMN: "1",
        PCR_COLUMN: "1",
        SECOND_ASSAY_COLUMN: "2",
    }
    return row | changes


def test_outcome_coded_site(spark, tmp_path):
    raw = csv(
        spark,
        tmp_path,
        "outcome",
        [
            outcome_row(PresentationALT="<5", PresentationCRP="n/a"),
            outcome_row(**{"PresentationID (unique identifier)": "p2", "AdmissionOxygenDeliveryDevice": "NV", OUTCOME_COLUMN: "2", SECOND_ASSAY_COLUMN: None}),
            outcome_row(**{"PresentationID (unique identifier)": "p3", "AdmissionOxygenDeliveryDevice": "96", PCR_COLUMN: "0", SECOND_ASSAY_COLUMN: "0"}),
            outcome_row(**{"PresentationID (unique identifier)": "p4", "AdmissionOxygenDeliveryDevice": "96", OUTCOME_COLUMN: "3"}),
        ],
    )
    found = sites.harmonise_outcome_coded(raw, "S").toPandas().set_index("encounter_id")
    assert list(found.index) == ["p1", "p2", "p4"]  # p3 was not tested
    assert list(found.label) == [1, 0, 1]
    assert found.arrival_ts["p1"] == dt.datetime(2021, 1, 3, 10, 20)
    assert found.blood_alt["p1"] == 5.0 and pd.isna(found.blood_crp["p1"])
    assert found.vital_oxygen_device["p1"] == 0 and found.vital_oxygen_device["p2"] == 1 and pd.isna(found.vital_oxygen_device["p4"])
    assert list(found.admission) == [1, 0, 0] and list(found.icu) == [0, 1, 0] and list(found.death) == [0, 0, 1]
    assert found.ethnicity["p1"] == "South Asian" and (found.site == "S").all()
    assert OUTCOME_COLUMN not in found.columns and PCR_COLUMN not in found.columns


def period_row(**changes):
    row = {c: "1" for c in PERIOD_SITE_COLUMNS}
    row |= {
        "StudyID": "s1",
        "period": "pandemic",
        "Ethnicity": "White - British",
        SEX_COLUMN: "0",
        "AdmissionOxygenDeliveryDevice": "O2HFN",
        PCR_COLUMN: "**DETECTED**",
        OUTCOME_COLUMN: "0",
        "admitted AMU": "0",
        "subsequently attended AMU": None,
        "unused": "x",
    }
    return row | changes


BLOOD_COUNT_RAW = [c for c, n in PERIOD_SITE_COLUMNS.items() if n.startswith("blood_")][:10]


def test_period_labelled_site(spark, tmp_path):
    blank = dict.fromkeys(BLOOD_COUNT_RAW)
    raw = csv(
        spark,
        tmp_path,
        "period",
        [
            period_row(),
            period_row(),
            period_row(StudyID="s2", period="pre-pandemic", **{PCR_COLUMN: None, OUTCOME_COLUMN: "2"}),
            period_row(StudyID="s3", **{OUTCOME_COLUMN: "4", "admitted AMU": "1", PCR_COLUMN: "Requested"}),
            period_row(StudyID="s4", **blank),
        ],
    )
    found = sites.harmonise_period_labelled(raw, "S").toPandas()
    assert sorted(found.encounter_id) == ["s1", "s2", "s3"]  # duplicate and row without blood counts are gone
    found = found.set_index("encounter_id").sort_index()
    assert list(found.columns[:1]) == ["episode_id"] and list(found.episode_id) == ["0", "s2", "s3"]
    assert list(found.admission) == [0, 1, 1] and list(found.death) == [0, 0, 1] and list(found.icu) == [0, 1, 0]
    assert found.label["s1"] == 1 and pd.isna(found.label["s2"]) and pd.isna(found.label["s3"])
    assert list(found.gender) == ["M"] * 3 and list(found.vital_oxygen_device) == [3] * 3
    assert found.arrival_ts["s1"] == dt.datetime(2020, 5, 8, 1) and found.arrival_ts["s2"] == dt.datetime(2019, 5, 18, 1)
    assert "unused" not in found.columns


def test_period_site_rejects_unreadable_results(spark, tmp_path):
    raw = csv(spark, tmp_path, "bad", [period_row(PresentationALT="haemolysed")])
    with pytest.raises(Exception, match="not a number"):
        sites.harmonise_period_labelled(raw, "S").collect()


def dual_row(**changes):
    row = {c: "1" for c in [*DUAL_SITE_COLUMNS, *DUAL_SITE_DROPPED]}
    row |= {"epis_sg2": "7", "YY": "2020", "MM": "4", "ethnic_origin": "Other-Chinese", "ED O2 Flowrate": None, "oxygen_mask": "5", "pcr_result": "0"}
    return row | changes


def test_dual_source_site_with_correction(spark, tmp_path):
    current = csv(
        spark,
        tmp_path,
        "current",
        [
            dual_row(**{"ED Pulse": None, "pulse": "88", "ALT": ">90"}),
            dual_row(epis_sg2="8", **{"ED O2 Flowrate": "12 l/min", "pcr_result": "1"}),
            dual_row(epis_sg2="9", pcr_result="1"),
        ],
    )
    before = csv(spark, tmp_path, "before", [{k: v for k, v in dual_row(epis_sg2="1", YY="2019").items() if k != "pcr_result"}])
    correction = csv(spark, tmp_path, "correction", [{"epis_sg2": "8", "pcr_result48": "9"}, {"epis_sg2": "7", "pcr_result48": "1"}])
    found = sites.harmonise_dual_eras(before, current, "S", correction).toPandas().set_index("encounter_id")
    assert found.label["1"] == 0 and found.label["7"] == 1 and pd.isna(found.label["8"]) and pd.isna(found.label["9"])
    assert list(found.loc[["7", "8", "9"]].correction_found) == [True, True, False]
    assert found.vital_heart_rate["7"] == 88.0 and found.blood_alt["7"] == 90.0
    assert found.vital_oxygen_device["7"] == 3 and found.vital_oxygen_device["8"] == 2
    assert found.arrival_ts["1"] == dt.datetime(2019, 4, 1) and (found.admission == 1).all()
    assert found.ethnicity["7"] == "Chinese" and not set(DUAL_SITE_DROPPED) & set(found.columns)


def test_common_site(spark, tmp_path):
    row = {c: "2" for c in DISPLAY_NAMES.values()} | {"ArrivalDateTime": "2020-01-05 07:08:09", "Ethnicity": "D", "Covid-19 Positive": None}
    found = sites.harmonise_common(csv(spark, tmp_path, "common", [row]), "S").first()
    assert found.ethnicity == "Mixed" and found.label is None and found.age == 2.0 and found.blood_mean_cell_vol == 2.0
    assert found.arrival_ts == dt.datetime(2020, 1, 5, 7, 8, 9)


def test_codes(spark):
    assert len(ETHNICITY_CODES) == 85
    rows = spark.createDataFrame([("NV",), ("CPAP",), ("elsewhere",), (None,), ("2",)], "c string")
    levels = level_map(DEVICE_TEXT_LEVELS)
    assert [r[0] for r in rows.select(device_level(rows.c, levels)).collect()] == [1, 3, None, 0, 2]
    assert {r.code for r in unmapped_devices(rows, "c", levels).collect()} == {"elsewhere", "2"}
    kept = rows.select(harmonise_ethnicity(rows.c)).collect()
    assert kept[1][0] == "CPAP" and kept[3][0] is None


def test_missing_file_and_malformed_lines(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="not found"):
        read_site_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    rows = read_site_csv(spark, str(tmp_path / "short.csv"), ["a", "b"]).collect()
    assert [(r.a, r.b, r[CORRUPT]) for r in rows] == [("1", "2", None), ("3", None, "3")]


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    frame = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "site string, blood_alt double")
    tables.write_table(frame, root, "encounters")
    assert (tmp_path / "encounters" / "site=A").exists()
    assert sorted(r.blood_alt for r in tables.read_table(spark, root, "encounters").collect()) == [1.0, 2.0]
    path = tables.export_csv(frame, f"{root}/out", display_names=True)
    assert spark.read.option("header", True).csv(path).columns == ["site", "Blood_Test ALT"]


def test_site_results(spark, tmp_path):
    results = spark.createDataFrame([("A", "LR", 1, "global", 0.9), ("A", "LR", 1, "personalised", 0.8), ("B", "LR", 1, "global", 0.7)], "site string, model string, round int, variant string, auc double")
    paths = tables.export_site_results(results, str(tmp_path), "A", True, ["global", "personalised"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a_global_self_evaluation", "a_personalised_self_evaluation"]
    assert spark.read.option("header", True).csv(paths[0]).first().auc == "0.9"
    assert tables.site_evaluation_name("A B", False, "global") == "a_b_global_prospective_evaluation"
