"""Row filters of the cohort definition. All are plain predicates, so Parquet scans can push them down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.specs import FEATURE_SETS


def at_time(df: DataFrame, column: str, when: str) -> Column:
    """A literal of the column's own timestamp type, so that the scan needs no cast."""
    return F.lit(when).cast(df.schema[column].dataType)


def filter_admitted(df: DataFrame, admission: str = "admission", icu: str = "icu") -> DataFrame:
    return df.where((F.col(admission) == 1) | (F.col(icu) == 1))


def filter_window(df: DataFrame, start: str | None = None, end: str | None = None, arrival: str = "arrival_ts") -> DataFrame:
    """Arrivals from `start` to `end`, both included; a cut-off without a time means its midnight."""
    if start is not None:
        df = df.where(F.col(arrival) >= at_time(df, arrival, start))
    if end is not None:
        df = df.where(F.col(arrival) <= at_time(df, arrival, end))
    return df


def split_eras(df: DataFrame, cut: str, arrival: str = "arrival_ts") -> tuple[DataFrame, DataFrame]:
    """Rows strictly before and strictly after the cut."""
    moment = at_time(df, arrival, cut)
    return df.where(F.col(arrival) < moment), df.where(F.col(arrival) > moment)


def filter_tested(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(0, 1))


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_all_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=list(columns))


def drop_thresh_missing(df: DataFrame, columns: Sequence[str], at_least: int = 5) -> DataFrame:
    return df.na.drop(thresh=at_least, subset=list(columns))


def select_feature_set(df: DataFrame, name: str, keep: Sequence[str] = ("encounter_id", "site", "label")) -> DataFrame:
    """Keys, label and the features of a named set."""
    return df.select(*keep, *FEATURE_SETS[name])


def case_cohort(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == 1)


def control_cohort(df: DataFrame, before: str, arrival: str = "arrival_ts") -> DataFrame:
    """Arrivals before the outbreak. Later negatives are neither cases nor controls."""
    return df.where(F.col(arrival) < at_time(df, arrival, before))


def cohort_union(cases: DataFrame, controls: DataFrame) -> DataFrame:
    return cases.unionByName(controls, allowMissingColumns=True)



def cohort_counts(df: DataFrame, by: Sequence[str] = ("site", "split")) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_positive"))
