"""From the sites' CSV extracts to one harmonised table, with a ledger of what was wrong with them.

Every file is parsed once: its lines are landed as Parquet in folders per state (sound, malformed, unreadable date). The
sound ones are harmonised, the others are the quarantine, and the ledger counts both from the landed tables, so that a
recomputed task cannot count a line twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.operators.harmonise import device_level, parse_arrival, quoted
from wardspan.plans.harmonise_sites import harmonise_common, harmonise_dual_eras, harmonise_dual_source, harmonise_outcome_coded, harmonise_period_labelled
from wardspan.session import compiled_methods, write_stage
from wardspan.sources.raw import CORRUPT, read_site_csv
from wardspan.specs import (
    ALL_BLOODS,
    BLOOD_GASES,
    COMMON_COLUMNS,
    DEVICE_FLOW_LEVELS,
    DEVICE_MASK_LEVELS,
    DEVICE_O2_LEVELS,
    DEVICE_TEXT_INVALID,
    DEVICE_TEXT_LEVELS,
    OUTCOME_SITE_COLUMNS,
    PERIOD_DATES,
    PERIOD_SITE_COLUMNS,
    VITALS,
    level_map,
)

STATE, DEVICES = "line_state", "unmapped_codes"
SOUND, MALFORMED, UNDATED = "sound", "malformed line", "unreadable date"
UNMAPPED, UNKNOWN_ID, UNCORRECTED = "unmapped device", "corrected id without encounter", "encounter without correction"

TEXTS = ["encounter_id", "site", "gender", "ethnicity"]
FLAGS = ["discharged", "admission", "icu", "death", "label"]
NUMBERS = ["age", "charlson_index", *VITALS, *ALL_BLOODS, *BLOOD_GASES]


@dataclass(frozen=True)
class Extract:
    """One site's files: `kind` is common, outcome, period or dual; only the dual kind has an earlier period and a correction."""

    site: str
    kind: str
    path: str
    before: str | None = None
    correction: str | None = None


@dataclass(frozen=True)
class Harmonised:
    """`encounters` in the common schema; `ledger` (site, check, detail, n); `quarantine` (site, line_state, line)."""

    encounters: DataFrame
    ledger: DataFrame
    quarantine: DataFrame


def _raw_name(mapping: dict[str, str], name: str) -> str:
    return next(raw for raw, engine in mapping.items() if engine == name)


#: Per kind the columns that tell the date.
DATES = {
    "common": (_raw_name(COMMON_COLUMNS, "arrival_ts"),),
    "outcome": (_raw_name(OUTCOME_SITE_COLUMNS, "arrival_ts"),),
    "period": (_raw_name(PERIOD_SITE_COLUMNS, "arrival_ts"),),
    "dual": ("YY", "MM"),
}
#: Per kind the device columns with their levels and invalid codes.
DEVICE_COLUMNS = {
    "common": [(_raw_name(COMMON_COLUMNS, "vital_oxygen_device"), {}, [])],
    "outcome": [(_raw_name(OUTCOME_SITE_COLUMNS, "vital_oxygen_device"), level_map(DEVICE_TEXT_LEVELS), DEVICE_TEXT_INVALID)],
    "period": [(_raw_name(PERIOD_SITE_COLUMNS, "vital_oxygen_device"), level_map(DEVICE_O2_LEVELS), [])],
    "dual": [("ED O2 Flowrate", level_map(DEVICE_FLOW_LEVELS, DEVICE_MASK_LEVELS), []), ("oxygen_mask", level_map(DEVICE_MASK_LEVELS), [])],
}


def readable_date(kind: str) -> Column:
    """Whether the date is missing or can be read."""
    columns = [quoted(c) for c in DATES[kind]]
    if kind == "dual":
        year, month = (c.try_cast("int") for c in columns)
        return (columns[0].isNull() | F.coalesce(year.between(1, 9999), F.lit(False))) & (columns[1].isNull() | F.coalesce(month.between(1, 12), F.lit(False)))
    if kind == "period":
        return columns[0].isNull() | columns[0].isin(list(PERIOD_DATES))
    return columns[0].isNull() | parse_arrival(columns[0]).isNotNull()


def unmapped_codes(kind: str, columns: Sequence[str]) -> Column:
    """The device texts of a line that have no level and are no numbers."""
    found = []
    for name, levels, invalid in DEVICE_COLUMNS[kind]:
        if name in columns:
            text = quoted(name)
            level = device_level(text, levels, None, invalid) if levels else text.try_cast("double").cast("int")
            found.append(F.when(text.isNotNull() & level.isNull() & ~text.isin(invalid), text))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def land(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The lines of a file as text columns with their state and unmapped device texts, written in folders per state.

    The header names the columns; a line with more or fewer fields is malformed. A kind's date columns have to be there
    (for the common kind, which may leave them out, only if it has them).
    """
    columns = read_site_csv(spark, path).columns
    raw = read_site_csv(spark, path, columns)
    dated = all(c in columns for c in DATES[kind])
    if not dated and kind != "common":
        raise ValueError(f"{path} has no column {' or '.join(DATES[kind])}")
    state = F.when(F.col(CORRUPT).isNotNull(), MALFORMED)
    if dated:
        state = state.when(~readable_date(kind), UNDATED)
    marked = raw.withColumns({STATE: state.otherwise(SOUND), DEVICES: unmapped_codes(kind, columns)})
    with compiled_methods(spark):
        return write_stage(marked, "extract", [STATE])


def _common_schema(df: DataFrame) -> DataFrame:
    """The columns of the common schema with their types; null where the site has none."""
    kinds = {**dict.fromkeys(TEXTS, "string"), "arrival_ts": "timestamp", **dict.fromkeys(NUMBERS, "double"), **dict.fromkeys(FLAGS, "int")}
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def correction_gaps(encounters: DataFrame, correction: DataFrame, key: str = "epis_sg2") -> DataFrame:
    """(check, n): distinct ids that only the correction file names, and those it leaves out. No row where there are none."""
    here = encounters.select(F.col(key).alias("id"), F.lit(True).alias("_here")).where("id IS NOT NULL").distinct()
    named = correction.select(F.col(key).alias("id"), F.lit(True).alias("_named")).where("id IS NOT NULL").distinct()
    gap = F.when(F.col("_here").isNull(), UNKNOWN_ID).when(F.col("_named").isNull(), UNCORRECTED)
    return here.join(named, "id", "full").select(gap.alias("check")).where("check IS NOT NULL").groupBy("check").agg(F.count("*").alias("n"))


def harmonise_extracts(spark: SparkSession, extracts: Sequence[Extract]) -> Harmonised:
    """Parse, judge and harmonise the extracts of all sites.

    Malformed lines and those whose date cannot be read are quarantined and take no further part; missing dates stay null.
    A device text without a level becomes null as before and is counted per code in the ledger, as are lines per state
    and, for corrected extracts, ids that do not match. A check without a row found nothing. Empty files are allowed.
    """
    harmonised, counts, set_aside = [], [], []
    for extract in extracts:
        if extract.kind not in DATES:
            raise ValueError(f"{extract.site}: no extract of kind {extract.kind}")
        files = [path for path in (extract.before, extract.path) if path]
        sound = []
        for path in files:
            landed = land(spark, path, extract.kind)
            raw = [c for c in landed.columns if c not in (CORRUPT, STATE, DEVICES)]
            sound.append(landed.where(F.col(STATE) == SOUND).select(*[quoted(c) for c in raw]))
            bad = landed.where(F.col(STATE) != SOUND)
            line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[quoted(c) for c in raw])))
            set_aside.append(bad.select(F.lit(extract.site).alias("site"), STATE, line.alias("line")))
            states = landed.groupBy(F.col(STATE).alias("check")).agg(F.count("*").alias("n"))
            codes = landed.where(F.col(STATE) == SOUND).select(F.explode(DEVICES).alias("detail")).groupBy("detail").agg(F.count("*").alias("n"))
            counts.append(states.select(F.lit(extract.site).alias("site"), "check", F.lit(None).cast("string").alias("detail"), "n"))
            counts.append(codes.select(F.lit(extract.site).alias("site"), F.lit(UNMAPPED).alias("check"), "detail", "n"))
        correction = None
        if extract.correction:
            correction = read_site_csv(spark, extract.correction)
            gaps = correction_gaps(sound[-1], correction)
            counts.append(gaps.select(F.lit(extract.site).alias("site"), "check", F.lit(None).cast("string").alias("detail"), "n"))
        if extract.kind == "dual":
            rows = harmonise_dual_eras(*sound, extract.site, correction) if extract.before else harmonise_dual_source(sound[-1], extract.site, correction)
        else:
            build = {"common": harmonise_common, "outcome": harmonise_outcome_coded, "period": harmonise_period_labelled}[extract.kind]
            rows = build(sound[-1], extract.site)
        harmonised.append(_common_schema(rows))
    if not harmonised:
        raise ValueError("no extracts")
    ledger = reduce(DataFrame.unionAll, counts).groupBy("site", "check", "detail").agg(F.sum("n").alias("n"))
    with compiled_methods(spark):
        encounters = write_stage(reduce(DataFrame.unionAll, harmonised), "harmonised", ["site"])
    return Harmonised(encounters, write_stage(ledger, "ledger"), reduce(DataFrame.unionAll, set_aside))
