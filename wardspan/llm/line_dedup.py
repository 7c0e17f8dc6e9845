"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

The index is a list of runs, each a table sorted by line key and dealt into the same buckets. A new batch of documents
is reduced to its line keys, merge-anti-joined with the runs to find the keys nobody brought before, and added as a run
of its own. Once a level holds `fan_out` runs they are merged into one run of the next level.

Batches arrive by falling doc_id, so the batch that brings a key first also holds its largest doc_id: the keeper.
Later batches only add to the number of documents.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspan.llm.tables import delete_folder
from wardspan.session import new_stage_path, write_stage

BLANKS = " \t\x0b\x0c\r\n"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["k1", "k2"]
#: A key in more than this share of the lines is joined by broadcast: at most 1 / HOT_SHARE keys can be that frequent.
HOT_SHARE = 1e-3


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed(key: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, body, pos (from 0), k1, k2 of every line whose key has `min_chars` code points or more."""
    keys = F.transform(split_lines(F.col("text")), line_key)
    lines = docs.select("doc_id", "body", F.posexplode(keys).alias("pos", "key"))
    return lines.where(F.length("key") >= min_chars).select("doc_id", "body", "pos", *hashed(F.col("key")))


def body_hash() -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64("text").alias("body")


@dataclass
class LineIndex:
    """Levelled runs of (k1, k2, n_docs, keeper), each bucketed and sorted by key."""

    spark: SparkSession
    buckets: int = 16
    fan_out: int = 2
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def read(self, names: list[str]) -> DataFrame:
        """All rows of some runs, as one scan of their files."""
        return self.spark.read.schema("k1 long, k2 long, n_docs long, keeper long").parquet(*[self.paths[name] for name in names])

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_stage_path(self.spark, name)
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_folder(self.spark, self.paths.pop(name))

    def drop(self) -> None:
        """Remove all runs."""
        for name in self.runs():
            self._drop(name)
        self.levels = []

    def add(self, keys: DataFrame) -> None:
        """Add a batch's keys (k1, k2, n_docs, last_doc); keys that no run has get the batch's last_doc as keeper."""
        batch = write_stage(keys, "line-batch")
        fresh = batch
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        counted = batch.select(*KEY, "n_docs", F.lit(None).cast("long").alias("keeper"))
        first = fresh.select(*KEY, F.lit(0).cast("long").alias("n_docs"), F.col("last_doc").alias("keeper"))
        self._place(self._write(merged(counted.unionAll(first) if self.levels else batch.withColumnRenamed("last_doc", "keeper"))), 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_out:
            names, self.levels[level] = self.levels[level], []
            self._place(self._write(merged(self.read(names))), level + 1)
            for old in names:
                self._drop(old)

    def contents(self) -> DataFrame:
        """One row per key: k1, k2, n_docs, keeper."""
        if not self.runs():
            return self.spark.createDataFrame([], "k1 long, k2 long, n_docs long, keeper long")
        return merged(self.read(self.runs()))


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Lowest doc_id of each batch but the last, falling; from approximate percentiles of doc_id."""
    shares = [1 - (b + 1) / batches for b in range(batches - 1)]
    if not shares:
        return []
    row = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000).alias("at")).first()
    return sorted(set(row["at"] or []), reverse=True)


def build_index(docs: DataFrame, min_chars: int = 40, batches: int = 3, fan_out: int = 2, buckets: int | None = None) -> LineIndex:
    """Feed the documents by falling doc_id, a batch at a time; rows without doc_id come last."""
    spark = docs.sparkSession
    index = LineIndex(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)
    bounds = batch_bounds(docs, batches)
    for k in range(len(bounds) + 1):
        doc_id = F.col("doc_id")
        below = doc_id < bounds[k - 1] if k else F.lit(True)
        above = doc_id >= bounds[k] if k < len(bounds) else F.lit(True)
        inside = below & above
        batch = docs.where(F.coalesce(inside, F.lit(k == len(bounds))))
        index.add(batch_keys(batch, min_chars))
    return index


def batch_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """k1, k2, n_docs, last_doc of every long line key of a batch; a row counts a key once."""
    keys = F.filter(F.transform(split_lines(F.col("text")), line_key), lambda key: F.length(key) >= min_chars)
    each = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).select("doc_id", *hashed(F.col("key")))
    return each.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def dropped_lines(docs: DataFrame, common: DataFrame, n_keys: int, min_chars: int) -> DataFrame:
    """owner, owner_body and the positions of the lines that `common` (k1, k2, n_docs, keeper) takes away.

    Keys with more than HOT_SHARE of all (document, key) pairs are few by count and go by broadcast; their rows are
    spread over the tasks of the shuffle that joins all other keys.
    """
    hot = F.col("n_docs") > HOT_SHARE * n_keys
    often = common.where(hot).select(*KEY, F.col("keeper").alias("hot_keeper"), F.lit(True).alias("hot"))
    others = common.where(~hot).select(*KEY, "keeper", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("met"))
    spread = F.when(F.col("hot"), F.xxhash64("doc_id", "pos")).otherwise(F.lit(0).cast("long"))
    lines = long_lines(docs, min_chars).join(F.broadcast(often), KEY, "left").withColumn("spread", spread)
    judged = lines.join(others, [*KEY, "spread"], "left").where(F.col("hot") | F.col("met"))
    keeper = F.when(F.col("hot"), F.col("hot_keeper")).otherwise(F.col("keeper"))
    lost = judged.where(~keeper.eqNullSafe(F.col("doc_id")))
    return lost.groupBy(F.col("doc_id").alias("owner"), F.col("body").alias("owner_body")).agg(F.collect_set("pos").alias("lost"))


def with_lost_lines(docs: DataFrame, min_chars: int, min_docs: int, **index) -> DataFrame:
    """doc_id, text, others (a struct of all other columns), lost (positions of the lines that go, or null) of every row."""
    named = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*[F.col(f"`{c}`") for c in named]) if named else F.lit(None)
    rows = docs.select("doc_id", "text", others.alias("others"))
    docs = rows.select("doc_id", "text", body_hash())
    built = build_index(docs, min_chars, **index)
    common = write_stage(built.contents().where(F.col("n_docs") >= min_docs), "common-lines")
    n_keys = built.read(built.runs()).agg(F.sum("n_docs")).first()[0] or 0
    built.drop()
    lost = dropped_lines(docs, common, n_keys, min_chars)
    same = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("body") == F.col("owner_body"))
    return rows.withColumn("body", F.xxhash64("text")).join(lost, same, "left").select("doc_id", "text", "others", "lost")


def kept_text() -> Column:
    """The text of a row of `with_lost_lines` without its lost lines; null texts become empty."""
    lines = split_lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n")
    return F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, **index) -> DataFrame:
    """Drop lines that many documents share, except in the document with the largest doc_id.

    Needs columns doc_id and text and ignores all others. Returns per row of `docs`: doc_id, n_lines, n_dropped,
    kept_text. A line counts if its key (`line_key`) has at least `min_chars` code points and occurs in at least
    `min_docs` rows. Null or empty text is one empty line and stays empty. Every row counts as a document: a repeated
    row adds to the count, and rows that share the keeper's doc_id all keep the line. Rows without doc_id are
    documents too but keep a common line only if no holder has an id. An empty table gives an empty table.
    """
    rows = with_lost_lines(docs.select("doc_id", "text"), min_chars, min_docs, **index)
    return rows.select(
        "doc_id",
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        kept_text().alias("kept_text"),
    )


def replace_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, **index) -> DataFrame:
    """`docs` with all its columns, each text without the lines that `dedup_lines` drops; n_chars follows the text."""
    rows = with_lost_lines(docs, min_chars, min_docs, **index).withColumn("kept", kept_text())
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*[columns.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])
