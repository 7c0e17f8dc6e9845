"""Small helpers around tables: deleting stages, running work on Arrow batches, components of link graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wardspan.session import write_stage


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_tasks(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """Run `make` over the Arrow batches of each task; it yields column dictionaries of arrays."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            arrays = [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, schema)


def map_batches(rows: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Run `make` over each Arrow batch; it yields column dictionaries of arrays."""
    return map_tasks(rows, lambda batches: (columns for batch in batches for columns in make(batch)), schema)


def sample_bound(total: int, most: int) -> int:
    """How many of the 2^63 hash values pick a text, so that about `most` of `total` texts are picked."""
    return (1 << 63) if total <= most else max(1, (most << 63) // total)


def picked(order: Column, total: int, most: int) -> Column:
    """Whether a 64-bit hash is among those that `sample_bound` picks; alike for all copies of a text."""
    return F.shiftrightunsigned(order, 1) <= F.lit(sample_bound(total, most) - 1)


def distinct_texts(docs: DataFrame, order: Column) -> int:
    """About how many distinct texts there are: a sample of a share of the rows would be empty if all are copies of one."""
    return docs.agg(F.approx_count_distinct(order)).first()[0]


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): one row per linked node with the smallest node it reaches.

    Every round hooks each node to its smallest neighbour if that is smaller, follows the hooks to their roots and
    contracts the links; a link graph of n nodes needs about log n rounds. Rows of one node are joined with plain
    equi-joins, whose skewed keys adaptive execution splits.
    """
    links = write_stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        hooks = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        roots = links.select(F.col("a").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti")
        forest = write_stage(hooks.unionAll(roots.select("node", F.col("node").alias("root"))), "hooks")
        while True:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = write_stage(forest.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks")
            moved = not higher.where("moved").isEmpty()
            forest = higher.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = forest
        else:
            further = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = write_stage(labels.join(further, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
        ends = [forest.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        lifted = links.join(ends[0], "a").join(ends[1], "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        links = write_stage(lifted.where("a < b").distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
