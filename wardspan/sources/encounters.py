"""Encounters derived from the order tables: one per order, its site the customer's region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.operators.filters import at_time
from wardspan.operators.harmonise import harmonise_ethnicity
from wardspan.specs import ORDER_FEATURES, RunSettings, SiteSpec

CONTROL_BEFORE = "1998-01-01"
TRAIN_UNTIL = "2000-06-30"
VALIDATE_FROM = "2000-07-01"
EXTERNAL_SITE = "MIDDLE EAST"
SCALE_SITE = "AFRICA"
TRAIN_ONLY_SITE = "EUROPE"

# Market segment -> ethnicity code.
SEGMENT_CODES = {"AUTOMOBILE": "A", "BUILDING": "J", "FURNITURE": "M", "HOUSEHOLD": "R", "MACHINERY": "CX"}

SITES = (
    SiteSpec("AFRICA", train_from="1995-01-01", train_until=TRAIN_UNTIL, validate_from=VALIDATE_FROM),
    SiteSpec("AMERICA", train_until=TRAIN_UNTIL, validate_from=VALIDATE_FROM),
    SiteSpec("ASIA", train_until=TRAIN_UNTIL, validate_from=VALIDATE_FROM),
    SiteSpec("EUROPE", train_until=TRAIN_UNTIL),
    SiteSpec("MIDDLE EAST", fits=False, validate_from=VALIDATE_FROM, scale_from=SCALE_SITE),
)


def order_settings(**changes) -> RunSettings:
    """Run settings for the order encounters."""
    return RunSettings(**{"features": tuple(ORDER_FEATURES), "control_before": CONTROL_BEFORE, "sites": SITES, **changes})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("encounter_id"))
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.avg("l_extendedprice").alias("avg_price"),
            F.max("l_extendedprice").alias("max_price"),
            F.avg("l_discount").alias("avg_discount"),
            F.avg("l_tax").alias("avg_tax"),
            F.count("*").cast("double").alias("n_lines"),
        )
    )


def sited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and region."""
    customers = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_acctbal", "c_mktsegment", F.col("r_name").alias("site"))
    )
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def ethnicity_code(segment) -> F.Column:
    pairs = [F.lit(part) for pair in SEGMENT_CODES.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), segment)


def encounters(spark: SparkSession, sf_dir: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per order: demographics, features with gaps, a nullable label and outcome flags.

    Early orders whose risk score would make them positive are left out, so that controls are true
    negatives. Every eleventh order lacks its price features.
    """
    joined = (
        sited_orders(spark, sf_dir).withColumnRenamed("o_orderkey", "encounter_id")
        .join(line_features(spark, sf_dir), "encounter_id", "left")
    )
    risk = (
        F.coalesce("sum_qty", F.lit(0.0)) / 100
        + F.col("o_totalprice") / 250000
        + ((F.col("encounter_id") * 7919 + 104729) % 1000) / 1000.0
    )
    early = F.col("o_orderdate") < at_time(joined, "o_orderdate", CONTROL_BEFORE)
    gap = F.col("encounter_id") % 11 == 0
    outcome = F.col("encounter_id") % 4
    high = F.col("risk") > 3.4
    return (
        joined.withColumn("risk", risk)
        .where(~(early & high))
        .select(
            "encounter_id",
            "site",
            F.col("o_orderdate").alias("arrival_ts"),
            (18 + F.col("o_custkey") % 73).cast("double").alias("age"),
            F.when(F.substring(F.md5(F.concat(F.lit("g"), F.col("o_custkey").cast("string"))), 1, 1) < "8", "F")
            .otherwise("M")
            .alias("gender"),
            harmonise_ethnicity(ethnicity_code(F.col("c_mktsegment"))).alias("ethnicity"),
            "sum_qty",
            *[F.when(~gap, F.col(c)).alias(c) for c in ("avg_price", "max_price", "avg_discount")],
            "avg_tax",
            "n_lines",
            F.col("o_totalprice").alias("total_price"),
            F.col("c_acctbal").alias("account_balance"),
            F.when(~early, high.cast("int")).alias("label"),
            *[(outcome == i).cast("int").alias(n) for i, n in enumerate(("discharged", "admission", "icu", "death"))],
            *extra,
        )
    )
