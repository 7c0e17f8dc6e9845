"""CSV extracts of the sites, label corrections and stored artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def text_schema(columns: Sequence[str], corrupt: bool = False) -> T.StructType:
    names = [*columns, CORRUPT] if corrupt else list(columns)
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_site_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a site's CSV with every column as text.

    With `columns` the file is read against that layout and malformed lines are kept, marked in
    `_corrupt_record`; without it the header names the columns. A missing file stops with a message.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    try:
        if columns is None:
            return reader.csv(path)
        layout = text_schema(columns, corrupt=True)
        return reader.schema(layout).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"File {path} not found.") from error


def union_eras(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Stack the extracts of two periods; columns only one of them has become null in the other."""
    return earlier.unionByName(current, allowMissingColumns=True)


def apply_correction(
    encounters: DataFrame,
    correction: DataFrame,
    key: str = "encounter_id",
    correction_key: str = "epis_sg2",
    correction_label: str = "pcr_result48",
    invalid: str = "9",
) -> DataFrame:
    """Let a later label file supersede the label, also where its result is invalid (then null).

    Rows are joined by id. `correction_found` tells which rows the file names; the others lose their
    label too, because the file supersedes the earlier extract as a whole. Results are compared as numbers, so `9.0` is
    invalid like `9`. An id that is named twice counts once; different results for one id are an error.
    """
    code = F.trim(F.col(f"`{correction_label}`").cast("string")).try_cast("double")
    named = correction.select(
        F.col(f"`{correction_key}`").cast("string").alias("_key"),
        F.when(code != float(invalid), code.cast("int")).alias("_label"),
    )
    agree = F.count_distinct(F.coalesce("_label", F.lit(-1))) == 1
    conflict = F.raise_error(F.concat(F.lit("different corrections of "), F.coalesce("_key", F.lit("null")))).cast("int")
    replacement = named.groupBy("_key").agg(
        F.when(agree, F.max("_label")).otherwise(conflict).alias("_label"), F.lit(True).alias("_found")
    )
    return (
        encounters.withColumn("_key", F.col(key).cast("string"))
        .drop("label")
        .join(replacement, "_key", "left")
        .withColumn("label", F.col("_label"))
        .withColumn("correction_found", F.coalesce("_found", F.lit(False)))
        .drop("_key", "_label", "_found")
    )
