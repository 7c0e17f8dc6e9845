"""Spark session settings shared by the bench, the tests and the command line."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardspan", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`.

    A temporary folder is made only when the setting is missing and Spark runs in one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="wardspan-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wardspan/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the shared folder, in folders per value of the `by` columns, and read it back.

    This cuts the lineage and survives lost executors.
    """
    path = new_stage_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


#: The JVM never compiles a longer method.
COMPILED_METHOD_BYTES = "8000"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs over rows of very many columns: stages whose generated method the JVM would only interpret run operator by
    operator, in methods short enough to be compiled."""
    name = "spark.sql.codegen.hugeMethodLimit"
    given = spark.conf.get(name, None)
    spark.conf.set(name, COMPILED_METHOD_BYTES)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, given)
