"""Engine tables on shared storage: harmonised encounters, cohorts, statistics, parameters, results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wardspan.sources.files import file_states, put_file, read_file
from wardspan.specs import DISPLAY_NAMES

PARTITIONS = {
    "encounters": ["site"],
    "cohort": ["site"],
    "prepared": ["split"],
    "site_stats": [],
    "params": ["model", "round"],
    "scores": ["model", "round"],
    "results": ["model", "round"],
    "roc": ["model", "round"],
    "attributions": ["model"],
}


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> str:
    """Write one engine table as Parquet with its usual partition columns."""
    path = f"{root.rstrip('/')}/{table}"
    keys = [c for c in PARTITIONS.get(table, []) if c in df.columns]
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}")


def export_csv(df: DataFrame, path: str, display_names: bool = False) -> str:
    """CSV export with a header; `display_names` writes the common column names."""
    if display_names:
        df = df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES})
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def site_evaluation_name(site: str, trains_only: bool, variant: str) -> str:
    """Name of a site's evaluation table: self-evaluation without a validation period of its own."""
    kind = "self" if trains_only else "prospective"
    return f"{site.lower().replace(' ', '_')}_{variant}_{kind}_evaluation"


def export_site_results(results: DataFrame, root: str, site: str, trains_only: bool, variants: Sequence[str]) -> list[str]:
    """One CSV per variant with a site's rounds, named after the kind of evaluation."""
    paths = []
    for variant in variants:
        rows = results.where((results.site == site) & (results.variant == variant)).orderBy("model", "round")
        paths.append(export_csv(rows, f"{root.rstrip('/')}/{site_evaluation_name(site, trains_only, variant)}"))
    return paths


@lru_cache(maxsize=1)
def code_version() -> str:
    """A digest of the package's own source: results of other code are not reused."""
    root, digest = Path(__file__).resolve().parent.parent, hashlib.md5()
    for folder in (".", "functions", "operators", "plans", "sources"):
        for source in sorted((root / folder).glob("*.py")):
            digest.update(source.name.encode() + source.read_bytes())
    return digest.hexdigest()


def cache_key(df: DataFrame, *parts) -> str | None:
    """A key that changes with the code, the given parts, and the name, size or time of any file that `df` reads.

    None for a table that is not read from files only: nothing tells whether it is still the same.
    """
    files = file_states(df.sparkSession, df.inputFiles())
    local = any(name in df._jdf.queryExecution().optimizedPlan().toString() for name in ("LocalRelation", "LogicalRDD"))
    if not files or local:
        return None
    return hashlib.md5(json.dumps([code_version(), files, *parts], sort_keys=True, default=str).encode()).hexdigest()


def cached_tables(spark: SparkSession, root: str, key: str | None, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables built earlier under this key, or build and write them; they count once all of them are written."""
    if key is None:
        return build()
    folder = f"{root.rstrip('/')}/{key}"
    if read_file(spark, f"{folder}/whole.json") is None:
        built = build()
        for name, table in built.items():
            keys = [c for c in PARTITIONS.get(name, []) if c in table.columns]
            table.write.mode("overwrite").partitionBy(*keys).parquet(f"{folder}/{name}")
        columns = {name: json.loads(table.schema.json()) for name, table in built.items()}
        try:
            put_file(spark, f"{folder}/whole.json", json.dumps(columns))
        except FileExistsError:
            pass  # somebody else has finished the same tables
    schemas = {name: StructType.fromJson(given) for name, given in json.loads(read_file(spark, f"{folder}/whole.json")).items()}
    tables = {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items()}
    return {name: table.select(*[f"`{c}`" for c in schemas[name].names]) for name, table in tables.items()}
