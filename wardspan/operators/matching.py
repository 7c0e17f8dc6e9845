"""k:1 control matching without replacement.

Cases take their controls in case order: the first k unused ones of the case's own shuffled candidate
list. As in the published study, the shuffle is seeded alike for every case, so cases with the same
stratum and age (a *class*) share one list. That keeps the work linear: a control is listed once per
class whose age band covers it, never once per case.

A control goes to the class that reaches it first. When a class reaches it depends only on how many
controls ahead of it in the class's list the class itself obtained, so the sequential answer is the one
assignment that is consistent with itself. Classes of one stratum that are neighbours in age form *blocks* of
bounded size, and a task lets the cases of a block choose in their order. Controls listed in several blocks go
to the earliest of their claims, and the blocks choose again until no claim changes; where no control is shared,
the first choice is the answer. If one list alone exceeds the bound, its ranges are sorted separately instead:
running totals per class and the earliest class per control, in passes until nothing changes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.operators.scale import (
    ROWS_PER_BUCKET,
    lookup_join,
    pin_small,
    range_splits,
    running_totals,
)
from wardspan.session import new_stage_path, write_stage

STRATA = ("site", "gender", "ethnicity")
HASH_SPAN = 2.0**60
#: Ranked cases (four numbers each) are broadcast up to 16 MB.
BROADCAST_CASES = 500_000
SCOPE = ("site",)


def preference(strata: Sequence[str], seed: int):
    """The shuffle: 60 bits of an md5 of stratum, case age, control and seed."""
    text = F.concat_ws("|", *strata, F.col("case_age").cast("string"), F.col("control_id").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _eligible(df: DataFrame, strata: Sequence[str], age: str) -> DataFrame:
    return df.na.drop("any", subset=[*strata, age])


def _band_buckets(classes: DataFrame, strata: Sequence[str], band: float) -> DataFrame:
    """Classes repeated for every whole year their band touches."""
    low = F.floor(F.col("case_age") - band).cast("int")
    high = F.floor(F.col("case_age") + band).cast("int")
    return classes.withColumn("age_year", F.explode(F.sequence(low, high)))


def in_band(age: str, case_age: str, band: float):
    return (F.col(age) < F.col(case_age) + band) & (F.col(age) > F.col(case_age) - band)


def _list_sizes(classes: DataFrame, controls: DataFrame, strata: list[str], age: str, band: float) -> DataFrame:
    """Controls in the band of every class, from counts by stratum and age; no pair is made."""
    ages = (
        controls.groupBy(*strata, F.col(age).alias("control_age"))
        .agg(F.count("*").alias("n_controls"))
        .withColumn("age_year", F.floor("control_age").cast("int"))
    )
    return (
        _band_buckets(classes, strata, band)
        .join(ages, [*strata, "age_year"])
        .where(in_band("control_age", "case_age", band))
        .groupBy(*strata, "case_age")
        .agg(F.sum("n_controls").alias("n_candidates"))
    )


def match_candidates(
    cases: DataFrame,
    controls: DataFrame,
    strata: Sequence[str] = STRATA,
    age: str = "age",
    case_id: str = "encounter_id",
    band: float = 4.0,
) -> DataFrame:
    """How many controls each case could take: same stratum, age strictly inside the band.

    Both sides are counted by stratum and age before they meet, so no case-control pair is made.
    """
    strata = list(strata)
    classes = _eligible(cases, strata, age).select(*strata, F.col(age).alias("case_age")).distinct()
    sizes = _list_sizes(classes, _eligible(controls, strata, age), strata, age, band)
    keyed = cases.select(F.col(case_id).alias("case_id"), *strata, F.col(age).alias("case_age"))
    return lookup_join(keyed, sizes, [*strata, "case_age"]).withColumn(
        "n_candidates", F.coalesce("n_candidates", F.lit(0))
    )


def _classes(cases: DataFrame, controls: DataFrame, strata: list[str], age: str, k: int, band: float) -> DataFrame:
    """One row per stratum and case age that has any candidate.

    `reach` is the longest list prefix its cases can ever see: a class passes only over controls that it
    or a class with an overlapping band takes. `share` is the part of the hash range that holds so many
    of its controls with room to spare, null where that is all of them.
    """
    sizes = cases.groupBy(*strata, F.col(age).alias("case_age")).agg(F.count("*").alias("capacity"))
    sizes, _ = pin_small(sizes, "match-sizes")
    keys, width = ", ".join(f"`{c}`" for c in strata), f"{2 * float(band)!r}D"
    near = f"PARTITION BY {keys} ORDER BY double(case_age) RANGE BETWEEN {width} PRECEDING AND {width} FOLLOWING"
    reach = sizes.withColumn("reach", F.expr(f"sum(capacity) OVER ({near})") * k)
    listed = _list_sizes(sizes, controls, strata, age, band)
    share = (F.col("reach") * 1.2 + 6 * F.sqrt("reach") + 50) / F.col("n_candidates")
    classes = reach.join(listed, [*strata, "case_age"]).withColumn("share", F.when(share < 1, share))
    return pin_small(classes.withColumn("class_id", F.monotonically_increasing_id()), "match-classes")[0]


def _lists(classes: DataFrame, controls: DataFrame, strata: list[str], scope: list[str], age: str, band: float, seed: int) -> DataFrame:
    """The classes' shuffled lists as rows `(*scope, control_id, class_id, capacity, pref)`.

    A control is listed once per class whose band covers its age: up to seven times for ages in whole
    years. The end of a list that nobody can reach is cut off by its hash before it is written.
    """
    listed = lookup_join(
        controls.withColumn("age_year", F.floor(age).cast("int")),
        _band_buckets(classes, strata, band),
        [*strata, "age_year"],
        "inner",
    ).where(in_band(age, "case_age", band))
    hashed = listed.withColumn("pref", preference(strata, seed))
    place = F.col("pref").cast("double") / F.lit(HASH_SPAN)
    reachable = F.col("share").isNull() | (place < F.col("share"))
    return hashed.where(reachable).select(*scope, "control_id", "class_id", "capacity", "pref", F.lit(1).alias("won"))


def _complete_lists(classes: DataFrame, controls: DataFrame, strata: list[str], scope: list[str], age: str, band: float, seed: int) -> DataFrame:
    """The lists, with the rare ones written whole whose cut part came out shorter than their reach."""
    lists = write_stage(_lists(classes, controls, strata, scope, age, band, seed), "match-lists")
    cut = classes.where("share is not null")
    if cut.isEmpty():
        return lists
    kept = lists.groupBy("class_id").agg(F.count("*").alias("kept"))
    short, _ = pin_small(cut.join(kept, "class_id", "left").where("coalesce(kept, 0) < reach"), "match-short")
    if short.isEmpty():
        return lists
    whole = short.drop("kept").withColumn("share", F.lit(None).cast("double"))
    others = lists.join(short.select("class_id"), "class_id", "left_anti")
    return write_stage(others.unionByName(_lists(whole, controls, strata, scope, age, band, seed)), "match-lists")


def _moment(case: dict) -> tuple:
    """A case's turn as a value that sorts as Spark does, nulls first."""
    order, name = case["case_order"], case["case_id"]
    return order is not None, order or 0, name is not None, name if name is not None else 0


def choose(lists: pa.Table, cases: pa.Table, k: int) -> tuple[pa.Table, pa.Array, pa.Array]:
    """The sequential choice inside one block: the lists in reading order, the case that reached each row and whether it won.

    `elsewhere` is the earliest case of another block that reached the row's control; later cases do not get it.
    """
    lists = lists.take(pc.sort_indices(lists, [(c, "ascending") for c in ("class_id", "pref", "control_id")]))
    moments = [_moment(case) for case in cases.column("chosen").to_pylist()]
    turns = sorted(set(moments))
    turn_of = {moment: i for i, moment in enumerate(turns)}
    class_ids, starts = np.unique(lists.column("class_id").to_numpy(), return_index=True)
    ends = [*starts[1:].tolist(), lists.num_rows]
    at = dict(zip(class_ids.tolist(), starts.tolist(), strict=True))
    end = dict(zip(class_ids.tolist(), ends, strict=True))
    codes = lists.column("control_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    controls = codes.tolist()
    n_controls = int(codes.max()) + 1 if len(codes) else 0
    until, owner = [len(turns)] * n_controls, [-1] * n_controls
    elsewhere = lists.column("elsewhere").combine_chunks()
    for i in np.flatnonzero(elsewhere.is_valid().to_numpy(zero_copy_only=False)).tolist():
        until[controls[i]] = bisect_right(turns, _moment(elsewhere[i].as_py()))
    reached, won, first = [-1] * lists.num_rows, bytearray(lists.num_rows), [0] * len(turns)
    queue = sorted((turn_of[moment], class_id, n) for n, (moment, class_id) in enumerate(zip(moments, cases.column("class_id").to_pylist(), strict=True)))
    for turn, class_id, n in queue:
        first[turn] = n
        i, stop, wanted = at.get(class_id, 0), end.get(class_id, 0), k
        while wanted and i < stop:
            j = controls[i]
            reached[i] = turn
            if turn < until[j] and owner[j] in (-1, turn):
                owner[j], won[i] = turn, 1
                wanted -= 1
            i += 1
        at[class_id] = i
    by_turn = np.asarray([*first, -1])[np.asarray(reached, "int64")]
    claims = cases.column("chosen").combine_chunks().take(pa.array(by_turn, mask=by_turn < 0))
    return lists, claims, pa.array(np.frombuffer(won, "uint8").astype(bool))


def _blocks(classes: DataFrame, lists: DataFrame, strata: list[str], rows_per_block: int) -> DataFrame | None:
    """`(class_id, listed, block)`: neighbours in age up to about `rows_per_block` list rows; None if a class alone has more."""
    sizes, _ = pin_small(lists.groupBy("class_id").agg(F.count("*").alias("listed")), "match-listed")
    if not sizes.where(F.col("listed") > rows_per_block).isEmpty():
        return None
    so_far = F.sum("listed").over(Window.partitionBy(*strata).orderBy("case_age"))
    placed = classes.join(sizes, "class_id").withColumn("part", F.floor(so_far / rows_per_block))
    block = F.min("class_id").over(Window.partitionBy(*strata, "part"))
    return pin_small(placed.select("class_id", "listed", block.alias("block")), "match-blocks")[0]


def _choose_in_blocks(lists: DataFrame, ranked: DataFrame, blocks: DataFrame, scope: list[str], k: int) -> DataFrame:
    """`(*scope, control_id, chosen)` of the rows won, from choices inside the blocks that agree with one another."""
    spark = lists.sparkSession
    chosen = ranked.schema["chosen"].dataType
    rows = lookup_join(lists, blocks.select("class_id", "block"), ["class_id"], "inner").select(
        *scope, "control_id", "class_id", "pref", "block", F.lit(None).cast(chosen).alias("elsewhere")
    )
    # no case comes after the end of its list
    turns = lookup_join(ranked, blocks, ["class_id"], "inner").where(F.col("place") * k < F.col("listed")).select("block", "class_id", "chosen")
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("chosen", chosen), T.StructField("won", T.BooleanType())])

    def choice(listed: pa.Table, cases: pa.Table) -> pa.Table:
        listed, claims, won = choose(listed, cases, k)
        return listed.select(columns).append_column("chosen", claims).append_column("won", won)

    def chosen_rows(given: DataFrame) -> DataFrame:
        return given.groupBy("block").cogroup(turns.groupBy("block")).applyInArrow(choice, schema)

    spread = rows.groupBy(*scope, "control_id").agg((F.min("block") != F.max("block")).alias("shared"))
    if spread.where("shared").isEmpty():
        return write_stage(chosen_rows(rows).where("won").select(*scope, "control_id", "chosen"), "match-chosen")

    of_control = Window.partitionBy(*scope, "control_id")
    places = [new_stage_path(spark, "match-state") for _ in range(2)]
    while True:
        claimed = chosen_rows(rows).withColumn("_first", F.min(F.when(F.col("chosen").isNotNull(), F.struct("chosen", "block"))).over(of_control))
        second = F.min(F.when(F.col("block") != F.col("_first.block"), F.col("chosen"))).over(of_control)
        claimed = claimed.withColumn("_now", F.when(F.col("_first.block") != F.col("block"), F.col("_first.chosen")).otherwise(second))
        passed = claimed.select(
            *[c for c in columns if c != "elsewhere"], F.col("_now").alias("elsewhere"), "chosen", "won", (~F.col("_now").eqNullSafe(F.col("elsewhere"))).alias("changed")
        )
        changes = Observation()
        passed.observe(changes, F.count_if("changed").alias("n")).write.mode("overwrite").parquet(places[0])
        state = spark.read.schema(passed.schema).parquet(places[0])
        places.reverse()
        if changes.get["n"] == 0:
            return state.where("won").select(*scope, "control_id", "chosen")
        rows = state.select(*columns)


def match_controls(
    cases: DataFrame,
    controls: DataFrame,
    k: int = 10,
    strata: Sequence[str] = STRATA,
    age: str = "age",
    entity: str = "encounter_id",
    band: float = 4.0,
    seed: int = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Matched pairs `(site, control_id, case_id)`: at most `k` controls per case, no control twice.

    Ids need to be unique only inside a site (the SCOPE columns among the strata) and may be numbers or text. Cases
    choose in the order of their ids if these are whole numbers, else in the order of a hash of them. Tasks hold blocks of
    about `rows_per_bucket` list rows, or ranges of so many. Every pass writes its state to the shared folder, in turn to
    one of two places, so two copies exist at most.
    """
    strata = list(strata)
    scope = [c for c in SCOPE if c in strata]
    spark = cases.sparkSession
    cases = _eligible(cases, strata, age).select(*strata, age, F.col(entity).alias("case_id"))
    controls = _eligible(controls, strata, age).select(*strata, age, F.col(entity).alias("control_id"))
    whole = cases.schema["case_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    cases = cases.withColumn("case_order", F.col("case_id").cast("long") if whole else F.xxhash64(F.col("case_id").cast("string")))
    classes = _classes(cases, controls, strata, age, k, band)

    keyed = lookup_join(
        cases.withColumnRenamed(age, "case_age"),
        classes.select(*strata, "case_age", "class_id"),
        [*strata, "case_age"],
        "inner",
    )
    ranked = write_stage(
        running_totals(
            keyed.select("class_id", "case_order", "case_id", F.lit(1).alias("one")),
            ["class_id"],
            "case_order",
            ["one"],
            ties=["case_id"],
            splits=range_splits(cases, "case_order", rows_per_bucket=rows_per_bucket),
        ).select("class_id", F.col("one_before").cast("long").alias("place"), F.struct("case_order", "case_id").alias("chosen")),
        "match-cases",
    )
    state = _complete_lists(classes, controls, strata, scope, age, band, seed)
    blocks = _blocks(classes, state, strata, rows_per_bucket)
    if blocks is not None:
        return _choose_in_blocks(state, ranked, blocks, scope, k).select(*scope, "control_id", F.col("chosen.case_id").alias("case_id"))

    if ranked.count() <= BROADCAST_CASES:
        ranked = F.broadcast(ranked)
    longest = state.groupBy("class_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-longest // rows_per_bucket))
    splits = [i * HASH_SPAN / n_buckets for i in range(1, n_buckets)]
    reached_first = Window.partitionBy(*scope, "control_id")
    places = [new_stage_path(spark, "match-state") for _ in range(2)]
    while True:
        ahead = running_totals(state, ["class_id"], "pref", ["won"], ties=["control_id"], splits=splits)
        place = F.floor(F.col("won_before") / k).cast("long")
        ahead = ahead.drop("chosen", "changed").withColumn("place", F.when(place < F.col("capacity"), place))
        claims = ahead.join(ranked, ["class_id", "place"], "left")
        won = F.coalesce((F.col("chosen") == F.min("chosen").over(reached_first)).cast("int"), F.lit(0))
        passed = claims.withColumn("now", won).select(
            *scope,
            "control_id",
            "class_id",
            "capacity",
            "pref",
            "chosen",
            F.col("now").alias("won"),
            (F.col("now") != F.col("won")).alias("changed"),
        )
        changes = Observation()
        observed = passed.observe(changes, F.count_if("changed").alias("n"))
        observed.write.mode("overwrite").parquet(places[0])
        state = spark.read.schema(passed.schema).parquet(places[0])
        places.reverse()
        if changes.get["n"] == 0:
            return state.where("won = 1").select(*scope, "control_id", F.col("chosen.case_id").alias("case_id"))
