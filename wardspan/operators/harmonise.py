"""Renames, recodes and row rules that bring a site's extract into the common schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.functions.text import recode, to_number
from wardspan.specs import ETHNICITY_CODES, LABEL_TEXT, PERIOD_DATES


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def rename_standardise(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({raw: name for raw, name in mapping.items() if raw in df.columns})


def project_mapped(df: DataFrame, mapping: Mapping[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """Keep only mapped columns, in mapping order, under their new names."""
    return df.select(*[quoted(raw).alias(name) for raw, name in mapping.items()], *[quoted(c) for c in extra])


def drop_unused(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def coalesce_dual_source(df: DataFrame, fallbacks: Mapping[str, str]) -> DataFrame:
    """Primary reading, else the reading of the second recording system."""
    return df.withColumns({primary: F.coalesce(quoted(primary), quoted(second)) for primary, second in fallbacks.items()})


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_timestamp(year.cast("int"), month.cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


#: Day-first; days, months, hours and minutes have one or two digits, seconds and their fractions may be missing.
ARRIVAL_FORMATS = (
    "yyyy-M-d H:m[:s][.SSSSSS]",
    "yyyy-M-d'T'H:m[:s][.SSSSSS]",
    "yyyy-M-d",
    "d/M/yyyy H:m[:s][.SSSSSS]",
    "d/M/yyyy",
)


def parse_arrival(text: Column, formats: Sequence[str] = ARRIVAL_FORMATS) -> Column:
    """Arrival text to timestamp; the first format that fits is used, other text gives null.

    A format is only tried on text that has its separators: every failed attempt costs an exception.
    """
    return F.coalesce(*[F.when(_may_fit(text, f), F.try_to_timestamp(text, F.lit(f))) for f in formats])


def _may_fit(text: Column, form: str) -> Column:
    """Whether a text has the date separator that a format needs, and a colon if and only if the format has a time."""
    separated = reduce(and_, [text.contains(c) for c in "-/" if c in form], F.lit(True))
    return separated & (text.contains(":") if ":" in form else ~text.contains(":"))


def period_to_date(label: Column, dates: Mapping[str, str] = PERIOD_DATES) -> Column:
    return recode(label, dates, keep_unmapped=False).cast("timestamp")


def harmonise_ethnicity(column: Column) -> Column:
    return recode(column, ETHNICITY_CODES)


def device_level(column: Column, levels: Mapping[str, int], missing: int | None = 0, invalid: Sequence[str] = ()) -> Column:
    """Oxygen support 0-3 from a device or flow text.

    Missing text takes the level `missing`, codes in `invalid` become null, and text outside the map is
    read as a number where it is one.
    """
    text = column.cast("string")
    level = F.coalesce(recode(text, levels, keep_unmapped=False), to_number(text).cast("int"))
    return F.when(text.isNull(), F.lit(missing)).when(text.isin(list(invalid)), F.lit(None)).otherwise(level)


def unmapped_devices(df: DataFrame, column: str, levels: Mapping[str, int]) -> DataFrame:
    """How often each text outside the map occurs."""
    text = quoted(column).cast("string")
    outside = text.isNotNull() & recode(text, levels, keep_unmapped=False).isNull()
    return df.where(outside).groupBy(text.alias("code")).agg(F.count("*").alias("n"))


def outcome_flags(df: DataFrame, column: str, flags: Mapping[int, str]) -> DataFrame:
    """One 0/1 column per outcome code; a missing outcome sets none of them."""
    code = quoted(column).try_cast("double")
    return df.withColumns({name: F.coalesce((code == value).cast("int"), F.lit(0)) for value, name in flags.items()})


def admission_rule(flags: Sequence[Column]) -> Column:
    """Admitted when any of the flags is 1."""
    hit = F.lit(False)
    for flag in flags:
        hit = hit | F.coalesce(flag.try_cast("double") == 1, F.lit(False))
    return F.when(hit, 1).otherwise(0)


def episode_id(admission: Column, encounter_id: Column) -> Column:
    """The encounter id of admitted patients, else 0."""
    return F.when(admission == 0, F.lit("0")).otherwise(encounter_id.cast("string"))


def label_from_tests(*results: Column) -> Column:
    """Highest of the test codes, nulls skipped: 0 invalid, 1 negative, 2 positive."""
    code = F.greatest(*results) if len(results) > 1 else results[0]
    return F.when(code == 1, 0).when(code == 2, 1)


def label_from_text(result: Column, mapping: Mapping[str, int] = LABEL_TEXT) -> Column:
    """0/1 from the assay's text; requested or unknown results are missing."""
    return recode(result, mapping, keep_unmapped=False)


def sex_text(code: Column) -> Column:
    """1 -> F, 0 -> M; other codes pass through as text."""
    number = code.cast("string").try_cast("double")
    return F.when(number == 1, "F").when(number == 0, "M").otherwise(code.cast("string"))
