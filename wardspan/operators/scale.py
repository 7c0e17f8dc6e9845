"""Building blocks that keep every operator bounded: checked lookups and running totals without
one-task windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardspan.session import write_stage

SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20
SALTS = 64
ROWS_PER_BUCKET = 2_000_000
#: Size parameter of the quantile sketches: ranks are off by less than a thousandth.
SKETCH_SIZE = 8192


def pin_small(df: DataFrame, name: str = "small", limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a summary table once.

    Up to `limit` rows and SMALL_BYTES bytes it becomes a local table that is safe to broadcast; beyond that it is
    written to the shared folder and the caller has to join it by a shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit and rows.nbytes <= SMALL_BYTES:
        return (df if df.isLocal() else df.sparkSession.createDataFrame(rows, df.schema)), True
    return write_stage(df, name), False


def local_table(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A small driver-side table, such as one parameter vector per site."""
    target = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), to_arrow_schema(target)), target)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = SMALL_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a summary keyed by a few, possibly very unequal, groups.

    The summary is broadcast after its row count was checked. A larger one is replicated over `salts`
    so that a group with a large share of the rows is spread over that many tasks.
    """
    on = list(on)
    pinned, fits = pin_small(small, limit=limit)
    if fits:
        return big.join(F.broadcast(pinned), on, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    salted_small = pinned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def range_splits(
    df: DataFrame, order: str, splits: Sequence[float] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET
) -> Sequence[float]:
    """Split points that cut `order` into ranges of about `rows_per_bucket` rows; none for small data.

    One pass counts and sketches: every task's sketch is merged with a few others first, so that no task merges all.
    The ranges differ by about a thousandth of all rows, results do not depend on them. Known `splits` are returned
    unmeasured: a caller that has counted its rows passes an empty list.
    """
    if splits is not None:
        return splits
    value = F.col(order).cast("double")
    parts = df.select(value.alias("v"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("part"))
    sketches = parts.groupBy("part").agg(F.kll_sketch_agg_double("v", SKETCH_SIZE).alias("s"), F.count("v").alias("n"))
    whole = sketches.where("n > 0").agg(F.kll_merge_agg_double("s", SKETCH_SIZE).alias("s"), F.sum("n").alias("n"))
    row = whole.first()
    buckets = -(-(row["n"] or 0) // rows_per_bucket)
    if buckets <= 1:
        return []
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    held = df.sparkSession.createDataFrame([(row["s"],)], "s binary")
    return sorted(set(held.select(F.kll_sketch_get_quantile_double("s", ranks).alias("at")).first()["at"]))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: Sequence[str],
    *,
    descending: bool = False,
    ties: Sequence[str] = (),
    splits: Sequence[float] = (),
    next_values: Sequence[str] = (),
) -> DataFrame:
    """Add `<v>_before`, the sum of `v` over earlier rows of the same group, and `<v>_next`, its value
    in the following row.

    `order`, followed by `ties`, has to be unique inside a group. With `splits` no task sorts a whole group: ranges are
    sorted separately and the totals of the earlier ranges, one row per group and range, are added.
    """
    group = list(group)

    def direction(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    sort_keys = [direction(order), *[F.col(c) for c in ties]]

    def before(window, value: str) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if not splits:
        whole = Window.partitionBy(*group).orderBy(*sort_keys)
        return df.select(
            "*",
            *[before(whole, v).alias(f"{v}_before") for v in values],
            *[F.lead(v).over(whole).alias(f"{v}_next") for v in next_values],
        )

    edges = [float("-inf"), *splits, float("inf")]
    bucketed = Bucketizer(splits=edges, inputCol="_order", outputCol="_bucket", handleInvalid="error").transform(
        df.withColumn("_order", F.col(order).cast("double"))
    ).drop("_order")
    edge_row = F.max_by if descending else F.min_by
    totals = bucketed.groupBy(*group, "_bucket").agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values],
        *[edge_row(v, order).alias(f"_first_{v}") for v in next_values],
    )
    over_buckets = Window.partitionBy(*group).orderBy(direction("_bucket"))
    offsets = totals.select(
        *group,
        "_bucket",
        *[before(over_buckets, f"_sum_{v}").alias(f"_off_{v}") for v in values],
        *[F.lead(f"_first_{v}").over(over_buckets).alias(f"_edge_{v}") for v in next_values],
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*sort_keys)
    return bucketed.join(offsets, [*group, "_bucket"]).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(before(inside, v) + F.col(f"_off_{v}")).alias(f"{v}_before") for v in values],
        *[F.coalesce(F.lead(v).over(inside), F.col(f"_edge_{v}")).alias(f"{v}_next") for v in next_values],
    )
