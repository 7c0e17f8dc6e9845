"""Model bundles: all that a site needs to score its own patients, published as a whole and refitted by nobody.

A version is a folder with the statistics, pooled medians, averaged parameters and thresholds of every round. Its
manifest is written last and names every table with its rows and a digest; a folder without one is no version.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.operators.params import GLOBAL
from wardspan.operators.prepare import impute_and_scale
from wardspan.operators.scale import pin_small
from wardspan.operators.scoring import score_rows, threshold_label
from wardspan.plans.cohorts import Prepared, applied_stats, assign_roles
from wardspan.plans.federate import OUTSIDE, Federation, evaluate_external
from wardspan.sources.files import claim_file, names_in, put_file, read_file
from wardspan.sources.store import settings_from, settings_text
from wardspan.specs import RunSettings, SiteSpec

FORMAT = 1
TABLES = {
    "stats": "site string, feature string, median double, min double, max double",
    "pooled": "feature string, median double",
    "params": "model string, round int, w array<double>",
    # a threshold without site is the shared one, for sites that do not calibrate
    "thresholds": "model string, site string, round int, threshold double",
}


@dataclass(frozen=True)
class Bundle:
    """One published version."""

    version: int
    settings: RunSettings
    stats: DataFrame
    pooled: DataFrame
    params: DataFrame
    thresholds: DataFrame

    def rounds(self, model: str) -> list[int]:
        return sorted(row["round"] for row in self.params.where(F.col("model") == model).select("round").distinct().collect())

    def shared(self, model: str) -> dict[int, float]:
        """The shared threshold of each round."""
        rows = self.thresholds.where((F.col("model") == model) & F.col("site").isNull()).collect()
        return {row["round"]: row["threshold"] for row in rows}


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version-{version:06d}"


def _summary(table: DataFrame) -> dict:
    """Rows and a digest that does not depend on their order."""
    row = table.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*table.columns).cast("decimal(38, 0)")).alias("digest")).first()
    return {"rows": row["rows"], "digest": str(row["digest"] or 0)}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose manifest is there."""
    found = [name for name in names_in(spark, root) if name.startswith("version-")]
    return [int(name[8:]) for name in found if read_file(spark, f"{root.rstrip('/')}/{name}/manifest.json") is not None]


def publish_bundle(spark: SparkSession, root: str, settings: RunSettings, tables: dict[str, DataFrame]) -> int:
    """Write the tables named in TABLES as the next version and return its number.

    A number is claimed before anything is written, so that two publishers never share a folder.
    """
    taken = [int(name[8:]) for name in names_in(spark, root) if name.startswith("version-")]
    version = max(taken, default=0) + 1
    while not claim_file(spark, f"{_folder(root, version)}/claim"):
        version += 1
    summaries = {}
    for name, schema in TABLES.items():
        columns = [column.split()[0] for column in schema.split(", ")]
        kinds = dict(column.split() for column in schema.split(", "))
        path = f"{_folder(root, version)}/{name}"
        tables[name].select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).write.parquet(path)
        summaries[name] = _summary(spark.read.schema(schema).parquet(path))
    manifest = {"format": FORMAT, "version": version, "settings": json.loads(settings_text(settings)), "tables": summaries}
    put_file(spark, f"{_folder(root, version)}/manifest.json", json.dumps(manifest, sort_keys=True))
    return version


def publish_run(root: str, prepared: Prepared, run: Federation, settings: RunSettings) -> int:
    """Publish what a federation has learned: every round's averaged parameters and all thresholds."""
    spark = prepared.rows.sparkSession
    own = run.table("thresholds").select("model", "site", "round", "threshold")
    shared = [(model, None, r, float(t)) for model, cuts in run.shared.items() for r, t in cuts.items()]
    tables = {
        "stats": prepared.stats,
        "pooled": prepared.pooled,
        "params": run.table("params").where(F.col("site") == GLOBAL),
        "thresholds": own.unionByName(spark.createDataFrame(shared, TABLES["thresholds"])),
    }
    return publish_bundle(spark, root, settings, tables)


def load_bundle(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """A version (the latest, if none is named); one that is not whole raises ValueError."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise ValueError(f"{root} holds no published version")
        version = max(known)
    text = read_file(spark, f"{_folder(root, version)}/manifest.json")
    if text is None:
        raise ValueError(f"version {version} in {root} has no manifest: it was never finished")
    manifest = json.loads(text)
    if manifest["format"] != FORMAT:
        raise ValueError(f"version {version} has format {manifest['format']}, known is {FORMAT}")
    tables = {}
    for name, schema in TABLES.items():
        folder = f"{_folder(root, version)}/{name}"
        tables[name] = pin_small(spark.read.schema(schema).parquet(folder), name)[0] if names_in(spark, folder) else None
        if tables[name] is None or _summary(tables[name]) != manifest["tables"][name]:
            raise ValueError(f"table {name} of version {version} is not the one that was published")
    return Bundle(version, settings_from(json.dumps(manifest["settings"])), **tables)


def _for_sites(bundle: Bundle, sites: Sequence[SiteSpec] | None) -> RunSettings:
    """The bundle's settings with its own evaluation-only sites, or with others in their place."""
    if sites is None:
        return bundle.settings
    if any(site.fits for site in sites):
        raise ValueError("a stored model is applied to sites that do not fit")
    return replace(bundle.settings, sites=(*[s for s in bundle.settings.sites if s.fits], *sites))


def _with_stored_stats(rows: DataFrame, bundle: Bundle, settings: RunSettings) -> DataFrame:
    """Impute and scale with the mean of the stored medians and the donor's stored range."""
    return impute_and_scale(rows, applied_stats(bundle.stats, bundle.pooled, settings), list(settings.features))


def evaluate_stored(
    encounters: DataFrame,
    bundle: Bundle,
    model: str,
    sites: Sequence[SiteSpec] | None = None,
    only: Sequence[str] = OUTSIDE,
    rounds: Sequence[int] | None = None,
) -> DataFrame:
    """Metric rows of evaluation-only sites from their raw encounters, per round, at the stored shared thresholds.

    `sites` are those of the bundle's settings unless others are given, each with the fitting site whose range it takes.
    """
    settings = _for_sites(bundle, sites)
    kept = ["encounter_id", "site", "label", *settings.features]
    roles = assign_roles(encounters, settings).where(F.size("later") > 0)
    rows = roles.select(*kept, F.explode("later").alias("split")).where(F.col("split").isin(*only))
    rounds = list(rounds or bundle.rounds(model))
    params = bundle.params.where((F.col("model") == model) & F.col("round").isin(rounds)).select("round", "w")
    shared = {r: t for r, t in bundle.shared(model).items() if r in rounds}
    return evaluate_external(_with_stored_stats(rows, bundle, settings), model, params, shared, settings, only=only)


def score_stored(encounters: DataFrame, bundle: Bundle, model: str, round_no: int | None = None, sites: Sequence[SiteSpec] | None = None) -> DataFrame:
    """encounter_id, site, p, predicted of every encounter of the evaluation-only sites; no label is needed.

    The last stored round is used unless another is named. Where a round has no shared threshold, predicted is null.
    """
    settings = _for_sites(bundle, sites)
    round_no = round_no or max(bundle.rounds(model))
    outside = [s.name for s in settings.sites if not s.fits]
    rows = encounters.where(F.col("site").isin(outside)).select("encounter_id", "site", *settings.features)
    params = bundle.params.where((F.col("model") == model) & (F.col("round") == round_no)).select("w")
    scored = score_rows(_with_stored_stats(rows, bundle, settings), params, model, settings.features, (), settings.nn_hidden)
    threshold = F.lit(bundle.shared(model).get(round_no)).cast("double")
    return scored.select("encounter_id", "site", "p", threshold_label(F.col("p"), threshold).alias("predicted"))
