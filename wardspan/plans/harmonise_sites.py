"""One function per kind of site extract, each from raw text columns to the common schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.functions.text import coerce_numeric, require_numeric, strip_censor
from wardspan.operators.filters import dedupe_rows, drop_all_missing
from wardspan.operators.harmonise import (
    admission_rule,
    coalesce_dual_source,
    device_level,
    drop_unused,
    episode_id,
    first_of_month,
    harmonise_ethnicity,
    label_from_tests,
    label_from_text,
    outcome_flags,
    parse_arrival,
    period_to_date,
    project_mapped,
    quoted,
    rename_standardise,
    sex_text,
)
from wardspan.sources.raw import apply_correction, union_eras
from wardspan.specs import (
    ALL_BLOODS,
    BLOOD_COUNT,
    BLOOD_GASES,
    COMMON_COLUMNS,
    DEVICE_FLOW_LEVELS,
    DEVICE_MASK_LEVELS,
    DEVICE_O2_LEVELS,
    DEVICE_TEXT_INVALID,
    DEVICE_TEXT_LEVELS,
    DUAL_SITE_COLUMNS,
    DUAL_SITE_DROPPED,
    DUAL_SITE_FALLBACKS,
    LAB_COLUMNS,
    OUTCOME_COLUMN,
    OUTCOME_FLAGS,
    OUTCOME_FLAGS_DEATH_4,
    OUTCOME_SITE_COLUMNS,
    PCR_COLUMN,
    PERIOD_SITE_COLUMNS,
    SECOND_ASSAY_COLUMN,
    VITALS,
    level_map,
)

MEASURED_VITALS = [v for v in VITALS if v != "vital_oxygen_device"]


def _typed(df: DataFrame) -> DataFrame:
    """Vitals, age and flags as numbers; blank device readings as integers."""
    numbers = [c for c in ("age", "charlson_index", *MEASURED_VITALS) if c in df.columns]
    flags = [c for c in ("admission", "icu", "discharged", "death", "label") if c in df.columns]
    return coerce_numeric(df, numbers).withColumns(
        {c: F.col(c).cast("string").try_cast("double").cast("int") for c in flags}
    )


def harmonise_common(raw: DataFrame, site: str) -> DataFrame:
    """An extract that already carries the common names; only the ethnicity is recoded."""
    named = rename_standardise(raw, COMMON_COLUMNS)
    if "arrival_ts" in named.columns:
        named = named.withColumn("arrival_ts", parse_arrival(F.col("arrival_ts").cast("string")))
    labs = [c for c in [*ALL_BLOODS, *BLOOD_GASES, "vital_oxygen_device"] if c in named.columns]
    return _typed(coerce_numeric(named, labs)).withColumns(
        {"ethnicity": harmonise_ethnicity(F.col("ethnicity")), "site": F.lit(site)}
    )


def harmonise_outcome_coded(raw: DataFrame, site: str) -> DataFrame:
    """An extract with outcome codes, two assays and device texts; untested rows are removed."""
    named = outcome_flags(rename_standardise(raw, OUTCOME_SITE_COLUMNS), OUTCOME_COLUMN, OUTCOME_FLAGS)
    tests = [quoted(c).cast("string").try_cast("double").cast("int") for c in (PCR_COLUMN, SECOND_ASSAY_COLUMN)]
    named = named.withColumn("label", label_from_tests(*tests))
    named = named.withColumn(
        "vital_oxygen_device",
        device_level(F.col("vital_oxygen_device"), level_map(DEVICE_TEXT_LEVELS), 0, DEVICE_TEXT_INVALID),
    )
    cleaned = strip_censor(drop_unused(named, [OUTCOME_COLUMN, PCR_COLUMN, SECOND_ASSAY_COLUMN]))
    numeric = coerce_numeric(cleaned, [c for c in LAB_COLUMNS if c in cleaned.columns])
    dated = numeric.withColumn("arrival_ts", parse_arrival(F.col("arrival_ts").cast("string")))
    return (
        _typed(dated)
        .where(F.col("label").isNotNull())
        .withColumns({"ethnicity": harmonise_ethnicity(F.col("ethnicity")), "site": F.lit(site)})
    )


def harmonise_period_labelled(raw: DataFrame, site: str) -> DataFrame:
    """An extract with period labels instead of dates; duplicates and rows without blood counts go.

    A laboratory value that is no number stops the job.
    """
    flags = [OUTCOME_COLUMN, "admitted AMU", "subsequently attended AMU"]
    named = project_mapped(dedupe_rows(raw), PERIOD_SITE_COLUMNS, extra=flags)
    named = outcome_flags(named, OUTCOME_COLUMN, OUTCOME_FLAGS_DEATH_4)
    admitted = admission_rule([quoted("admitted AMU"), quoted("subsequently attended AMU"), F.col("icu")])
    named = named.withColumns(
        {
            "vital_oxygen_device": device_level(F.col("vital_oxygen_device"), level_map(DEVICE_O2_LEVELS)),
            "arrival_ts": period_to_date(F.col("arrival_ts")),
            "gender": sex_text(F.col("gender")),
            "label": label_from_text(F.col("label")),
            "admission": admitted,
        }
    )
    named = named.withColumn("episode_id", episode_id(F.col("admission"), F.col("encounter_id")))
    cleaned = require_numeric(strip_censor(drop_unused(named, flags)), LAB_COLUMNS)
    kept = drop_all_missing(cleaned, BLOOD_COUNT)
    ordered = ["encounter_id", "episode_id", *[c for c in kept.columns if c not in ("encounter_id", "episode_id")]]
    return _typed(kept.select(*ordered)).withColumns(
        {"ethnicity": harmonise_ethnicity(F.col("ethnicity")), "site": F.lit(site)}
    )


def harmonise_dual_source(raw: DataFrame, site: str, correction: DataFrame | None = None) -> DataFrame:
    """One period of the site with two recording systems; everyone counts as admitted.

    Without a result column (before the assay existed) the label is 0.
    """
    dated = raw.withColumn("arrival_ts", first_of_month(F.col("YY"), F.col("MM")))
    merged = coalesce_dual_source(dated, DUAL_SITE_FALLBACKS)
    flow = level_map(DEVICE_FLOW_LEVELS, DEVICE_MASK_LEVELS)
    mask = device_level(F.col("oxygen_mask"), level_map(DEVICE_MASK_LEVELS), None)
    merged = merged.withColumn("ED O2 Flowrate", F.coalesce(device_level(quoted("ED O2 Flowrate"), flow, None), mask))
    named = rename_standardise(drop_unused(merged, DUAL_SITE_DROPPED), DUAL_SITE_COLUMNS)
    if "pcr_result" in named.columns:
        named = named.withColumn("label", F.col("pcr_result").cast("string").try_cast("double").cast("int")).drop("pcr_result")
    else:
        named = named.withColumn("label", F.lit(0))
    named = strip_censor(named.withColumn("admission", F.lit(1)))
    if correction is not None:
        named = apply_correction(named, correction)
    numeric = coerce_numeric(named, [c for c in ALL_BLOODS if c in named.columns])
    return _typed(numeric).withColumns({"ethnicity": harmonise_ethnicity(F.col("ethnicity")), "site": F.lit(site)})


def harmonise_dual_eras(before: DataFrame, current: DataFrame, site: str, correction: DataFrame | None = None) -> DataFrame:
    """Both periods of that site; the correction concerns the current one."""
    return union_eras(harmonise_dual_source(before, site), harmonise_dual_source(current, site, correction))
