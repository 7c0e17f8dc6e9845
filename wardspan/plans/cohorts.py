"""From encounters to the prepared table: windows, matched cohort, imputation, scaling, splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.operators.filters import at_time, filter_admitted, filter_tested
from wardspan.operators.matching import match_controls
from wardspan.operators.prepare import impute_and_scale, mean_of_medians, site_stats, train_or_test
from wardspan.operators.scale import ROWS_PER_BUCKET, local_table, pin_small
from wardspan.session import shared_dir, write_stage
from wardspan.sources.store import settings_text
from wardspan.sources.tables import cache_key, cached_tables
from wardspan.specs import RunSettings, SiteSpec

MATCH_KEYS = ["gender", "ethnicity", "age"]


@dataclass
class Prepared:
    """Rows ready for training and evaluation, with the statistics they were prepared with."""

    rows: DataFrame
    stats: DataFrame
    pooled: DataFrame
    n_rows: int

    @property
    def splits(self) -> Sequence[float] | None:
        """Score ranges for the rank statistics: one range for few rows, else measured per score."""
        return () if self.n_rows <= ROWS_PER_BUCKET else None


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _training_window(encounters: DataFrame, settings: RunSettings) -> Column:
    windows = []
    for site in settings.sites:
        if site.fits:
            inside = F.col("site") == site.name
            if site.train_from:
                inside = inside & (F.col("arrival_ts") >= at_time(encounters, "arrival_ts", site.train_from))
            if site.train_until:
                inside = inside & (F.col("arrival_ts") <= at_time(encounters, "arrival_ts", site.train_until))
            windows.append(inside)
    return _any(windows)


def _validation_window(encounters: DataFrame, settings: RunSettings, fits: bool) -> Column:
    return _any(
        [
            (F.col("site") == s.name) & (F.col("arrival_ts") >= at_time(encounters, "arrival_ts", s.validate_from))
            for s in settings.sites
            if s.fits == fits and s.validate_from
        ]
    )


def external_sites(settings: RunSettings) -> list[SiteSpec]:
    return [s for s in settings.sites if not s.fits]


def training_rows(encounters: DataFrame, settings: RunSettings) -> DataFrame:
    """Admitted patients inside each fitting site's training window."""
    return filter_admitted(encounters.where(_training_window(encounters, settings)))


def validation_rows(encounters: DataFrame, settings: RunSettings, fits: bool = True) -> DataFrame:
    """Tested patients from each site's validation date on; evaluation-only sites keep admitted ones only."""
    rows = filter_tested(encounters.where(_validation_window(encounters, settings, fits)))
    return rows if fits else filter_admitted(rows)


def assign_roles(encounters: DataFrame, settings: RunSettings) -> DataFrame:
    """What every encounter is used for, decided in one pass.

    `role` is `case` or `control` for training rows; `later` lists the evaluation splits `validation`,
    `external` (evaluation-only sites from their validation date on) and `central` (those sites without
    a date rule). Rows without any use are dropped.
    """
    admitted = (F.col("admission") == 1) | (F.col("icu") == 1)
    tested = F.col("label").isin(0, 1)
    training = _training_window(encounters, settings) & admitted
    outside = F.col("site").isin([s.name for s in external_sites(settings)]) & tested & admitted
    before = F.col("arrival_ts") < at_time(encounters, "arrival_ts", settings.control_before)
    later = [
        F.when(_validation_window(encounters, settings, True) & tested, "validation"),
        F.when(_validation_window(encounters, settings, False) & outside, "external"),
        F.when(outside, "central"),
    ]
    marked = encounters.withColumns(
        {
            "role": F.when(training & (F.col("label") == 1), "case").when(training & before, "control"),
            "later": F.array_compact(F.array(*later)),
        }
    )
    return marked.where(F.col("role").isNotNull() | (F.size("later") > 0))


def case_control_set(roles: DataFrame, settings: RunSettings, matched: bool = True) -> DataFrame:
    """Mark in `fits` the cases and their matched controls (or all controls), with missing labels as 0."""
    fits = F.col("role").isNotNull()
    if matched:
        cases, controls = roles.where("role = 'case'"), roles.where("role = 'control'")
        pairs = match_controls(cases, controls, settings.match_ratio, band=settings.age_band)
        taken = pairs.select("site", F.col("control_id").alias("encounter_id"), F.lit(True).alias("_taken"))
        roles = roles.join(taken, ["site", "encounter_id"], "left")
        fits = F.coalesce((F.col("role") == "case") | F.col("_taken"), F.lit(False))
    label = F.when(F.col("role").isNotNull(), F.coalesce(F.col("label"), F.lit(0))).otherwise(F.col("label"))
    return roles.withColumns({"fits": fits, "label": label}).drop("_taken")


def applied_stats(stats: DataFrame, pooled: DataFrame, settings: RunSettings) -> DataFrame:
    """The statistics each site's rows are prepared with.

    Fitting sites use their own; evaluation-only sites the mean of medians and their donor's range.
    """
    own = stats.select("site", "feature", "median", "min", "max")
    donors = [{"outside": s.name, "site": s.scale_from} for s in external_sites(settings)]
    if not donors:
        return own
    borrowed = (
        local_table(stats.sparkSession, donors, "outside string, site string")
        .join(stats.drop("median"), "site")
        .join(pooled, "feature")
        .select(F.col("outside").alias("site"), "feature", "median", "min", "max")
    )
    return pin_small(own.unionByName(borrowed), "applied-stats")[0]


def prepare(encounters: DataFrame, settings: RunSettings, matched: bool = True, reuse: bool = False) -> Prepared:
    """The prepared table, splits `train`, `test`, `validation`, `external` and `central`.

    With `reuse` the tables of an earlier call are read if settings, code and input files are the same (`cache_key`).
    """
    if not reuse:
        return _prepare(encounters, settings, matched)
    spark = encounters.sparkSession

    def build() -> dict[str, DataFrame]:
        made = _prepare(encounters, settings, matched)
        return {"prepared": made.rows, "site_stats": made.stats, "pooled": made.pooled}

    key = cache_key(encounters, settings_text(settings), matched)
    tables = cached_tables(spark, f"{shared_dir(spark)}/wardspan/cohorts", key, build)
    rows = tables["prepared"]
    return Prepared(rows, pin_small(tables["site_stats"])[0], pin_small(tables["pooled"])[0], rows.count())


def _prepare(encounters: DataFrame, settings: RunSettings, matched: bool) -> Prepared:
    """Prepare from the encounters.

    The encounters are read once and the used rows written to the shared folder, because matching and
    the statistics read them again. Statistics come from the whole case-control set, before it is split.
    A site without a validation period is validated on its test rows.
    """
    features = list(settings.features)
    keep = ["encounter_id", "site", "label", *features, "role", "later", *(MATCH_KEYS if matched else [])]
    roles = write_stage(assign_roles(encounters, settings).select(*keep), "encounters")
    marked = case_control_set(roles, settings, matched).drop(*MATCH_KEYS)
    if matched:
        marked = write_stage(marked, "cohort")
    stats = site_stats(marked.where("fits").select("site", *features), features)
    pooled, _ = pin_small(mean_of_medians(stats), "pooled")

    split = train_or_test(F.col("encounter_id"), settings.test_share, settings.seed)
    self_validated = F.col("site").isin([s.name for s in settings.sites if s.trains_only]) & (split == "test")
    own = F.array(F.when(F.col("fits"), split), F.when(F.col("fits") & self_validated, "validation"))
    rows = marked.withColumn("split", F.explode(F.array_compact(F.concat(own, F.col("later")))))
    rows = impute_and_scale(rows, applied_stats(stats, pooled, settings), features)
    stored = write_stage(rows.select("encounter_id", "site", "split", "label", *features), "prepared", by=["split"])
    return Prepared(stored, stats, pooled, stored.count())


