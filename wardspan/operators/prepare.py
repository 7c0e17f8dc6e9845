"""Per-site statistics, imputation, scaling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspan.operators.scale import ROWS_PER_BUCKET, lookup_join, pin_small, running_totals

WHOLE_ROWS = 10_000
MEDIAN_VALUES = 1_000_000
NEAR = 0.001
MAX_PASSES = 100
STATS = ["median", "mean", "min", "max", "n_nonnull"]


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), [F.col(f).cast("double").alias(f) for f in features], name, value)


def _overview(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """Counts, range, mean and a bracket around the median, all features in one pass."""
    aggregates = []
    for f in features:
        x = f"double(`{f}`)"
        near = f"percentile_approx({x}, array({0.5 - NEAR}, {0.5 + NEAR}), 10000) AS near"
        row = f"'{f}' AS feature, count({x}) AS n_nonnull, min({x}) AS min, max({x}) AS max, avg({x}) AS mean, {near}"
        aggregates.append(F.expr(f"struct({row}) AS `{f}`"))
    wide = df.groupBy(by).agg(*aggregates)
    return wide.select(by, F.inline(F.array(*features)))


def exact_medians(
    df: DataFrame,
    overview: DataFrame,
    features: Sequence[str],
    by: str,
    whole_rows: int = WHOLE_ROWS,
    limit: int = MEDIAN_VALUES,
) -> DataFrame:
    """Exact median per group and feature without gathering a group.

    Values are counted one by one only inside a bracket around the median, taken from the overview's
    sketch; all values below it count as one. Groups up to `whole_rows` rows need no bracket. Where it
    would hold more than `limit` values, or turns out to miss the median, it is adjusted first.
    """
    long = unpivot(df, [by], features).where(F.col("value").isNotNull())
    keys = [by, "feature"]
    whole = F.col("n_nonnull") <= whole_rows
    start = overview.where("n_nonnull > 0").select(
        *keys,
        "n_nonnull",
        F.when(whole, F.col("min")).otherwise(F.col("near")[0]).alias("low"),
        F.when(whole, F.col("max")).otherwise(F.col("near")[1]).alias("high"),
    )
    held = F.col("n_nonnull") * 2 * NEAR
    if not overview.where(~whole & (held > limit)).isEmpty():
        start = _narrow(long, overview, start, keys, limit)
    found, _ = pin_small(_middle(long, start, keys), "medians")
    missed = found.where("median is null")
    if missed.isEmpty():
        return found
    again = start.join(missed.select(*keys), keys)
    return found.where("median is not null").unionByName(_middle(long, _narrow(long, overview, again, keys, limit), keys))


def _ranks() -> tuple[Column, Column]:
    """0-based ranks of the one or two middle values."""
    return F.expr("floor((n_nonnull - 1) / 2)"), F.expr("ceil((n_nonnull - 1) / 2)")


def _middle(long: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the middle values; null where the bracket does not hold them."""
    counted = (
        lookup_join(long, brackets, keys, "inner")
        .where(F.col("value") <= F.col("high"))
        .withColumn("value", F.expr("if(value < low, double('-Infinity'), value)"))
        .groupBy(*keys, "value", "n_nonnull")
        .agg(F.count("*").alias("n"))
    )
    placed = running_totals(counted, keys, "value", ["n"])
    middle = [
        F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("value")))
        for rank in _ranks()
    ]
    median = (middle[0] + middle[1]) / 2
    return placed.groupBy(*keys).agg(F.when(median > float("-inf"), median).alias("median"))


def _narrow(long: DataFrame, overview: DataFrame, brackets: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Adjust every bracket until it holds the median and at most about `limit` distinct values."""
    first, last = _ranks()
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    extent = overview.select(*keys, "min", "max")
    inside = F.when(value.between(low, high), value)
    for _ in range(MAX_PASSES):
        brackets, _ = pin_small(brackets, "median-brackets")
        seen = (
            lookup_join(long, brackets, keys, "inner")
            .groupBy(*keys, "n_nonnull", "low", "high")
            .agg(
                F.count_if(value < low).alias("below"),
                F.count(inside).alias("held"),
                F.approx_count_distinct(inside).alias("distinct_held"),
                F.percentile_approx(inside, [i / 512 for i in range(513)], 50_000).alias("grid"),
                F.count_if(value == low).alias("at_low"),
                F.count_if(value == high).alias("at_high"),
                F.min(F.when((value > low) & (value <= high), value)).alias("above_low"),
                F.max(F.when((value < high) & (value >= low), value)).alias("under_high"),
            )
        )
        seen, _ = pin_small(seen, "median-counts")
        end = F.col("below") + F.col("held")
        covered = (F.col("below") <= first) & (last < end)
        wide = covered & (F.col("distinct_held") > max(limit, 2))
        if seen.where(~covered | wide).isEmpty():
            return seen.select(*keys, "n_nonnull", "low", "high")
        cells = [F.floor((rank - F.col("below")) / F.col("held") * 512).cast("int") for rank in (first, last)]
        lower = F.try_element_at("grid", F.greatest(cells[0], F.lit(1)))
        upper = F.try_element_at("grid", F.least(cells[1] + 4, F.lit(513)))
        shrinks = (lower > low) | (upper < high)
        # where ties at both ends hide the middle from the sketch, the ends are cut off exactly
        past_low, past_high = first >= F.col("below") + F.col("at_low"), last < end - F.col("at_high")
        next_low = F.when(past_low, F.when(past_high, F.col("above_low")).otherwise(F.col("under_high"))).otherwise(low)
        next_high = F.when(past_high, F.when(past_low, F.col("under_high")).otherwise(F.col("above_low"))).otherwise(high)
        brackets = seen.join(extent, keys).select(
            *keys,
            "n_nonnull",
            F.when(~covered, F.col("min")).when(~wide, low).when(shrinks, lower).otherwise(next_low).alias("low"),
            F.when(~covered, F.col("max")).when(~wide, high).when(shrinks, upper).otherwise(next_high).alias("high"),
        )
    raise RuntimeError(f"no median bracket after {MAX_PASSES} passes")


def site_stats(df: DataFrame, features: Sequence[str], by: str = "site", whole_rows: int = WHOLE_ROWS, median_values: int = MEDIAN_VALUES) -> DataFrame:
    """`(site, feature, median, mean, min, max, n_nonnull)`, nulls skipped.

    The range before imputation equals the range after it, because a median lies inside its own range.
    """
    overview, _ = pin_small(_overview(df, features, by), "site-overview")
    medians = exact_medians(df, overview, features, by, whole_rows, median_values)
    stats = overview.drop("near").join(medians, [by, "feature"], "left").select(by, "feature", *STATS)
    return pin_small(stats, "site-stats")[0]


def mean_of_medians(stats: DataFrame) -> DataFrame:
    """Unweighted mean of the sites' medians per feature."""
    return stats.groupBy("feature").agg(F.avg("median").alias("median"))


def site_minmax(stats: DataFrame) -> DataFrame:
    return stats.select("site", "feature", "min", "max")


def _wide(stats: DataFrame, features: Sequence[str], columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with a column `_<statistic>_<feature>` each."""
    picked = [F.expr(f"max(if(feature = '{f}', `{c}`, NULL)) AS `_{c}_{f}`") for c in columns for f in features]
    return stats.groupBy(*by).agg(*picked)


def _attach(df: DataFrame, stats: DataFrame, features: Sequence[str], columns: Sequence[str], by: str) -> DataFrame:
    return lookup_join(df, _wide(stats, features, columns, [by]), [by])


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_median_", "_mean_", "_min_", "_max_"))])


def filled(f: str, strategy: str = "median") -> str:
    return f"coalesce(`{f}`, `_{strategy}_{f}`)"


def scaled(x: str, f: str) -> str:
    """(x - min) / (max - min); a constant feature keeps x - min, and nothing is clipped."""
    low, high = f"`_min_{f}`", f"`_max_{f}`"
    return f"({x} - {low}) / if({high} = {low}, 1D, {high} - {low})"


def impute_site(df: DataFrame, stats: DataFrame, features: Sequence[str], strategy: str = "median", by: str = "site") -> DataFrame:
    """Fill gaps with the site's own median (or mean)."""
    joined = _attach(df, stats, features, [strategy], by)
    return _without_helpers(joined.withColumns({f: F.expr(filled(f, strategy)) for f in features}))


def impute_federated(df: DataFrame, pooled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill gaps with the mean of the fitting sites' medians, one number per feature."""
    known = {row["feature"]: row["median"] for row in pooled.collect()}
    filling = [f for f in features if known.get(f) is not None]
    return df.withColumns({f: F.coalesce(F.col(f), F.lit(known[f])) for f in filling})


def minmax_scale(df: DataFrame, stats: DataFrame, features: Sequence[str], by: str = "site") -> DataFrame:
    joined = _attach(df, stats, features, ["min", "max"], by)
    return _without_helpers(joined.withColumns({f: F.expr(scaled(f"`{f}`", f)) for f in features}))


def scale_foreign(df: DataFrame, stats: DataFrame, features: Sequence[str], scale_site: str, by: str = "site") -> DataFrame:
    """Scale with another site's range, two numbers per feature."""
    donor = {row["feature"]: row for row in stats.where(F.col(by) == scale_site).collect()}
    ranges = {f: (donor[f]["min"], donor[f]["max"]) for f in features if donor[f]["min"] is not None}
    return df.withColumns(
        {f: (F.col(f) - low) / F.lit(high - low if high != low else 1.0) for f, (low, high) in ranges.items()}
    )


def impute_and_scale(df: DataFrame, stats: DataFrame, features: Sequence[str], by: str = "site") -> DataFrame:
    """Median imputation and scaling with one lookup."""
    joined = _attach(df, stats, features, ["median", "min", "max"], by)
    return _without_helpers(joined.withColumns({f: F.expr(scaled(filled(f), f)) for f in features}))


def seeded_hash(key: Column, seed: int | str) -> Column:
    """Hex hash of an id and a seed: the same in every run, whatever the partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def train_or_test(key: Column, test_share: float = 0.2, seed: int = 42) -> Column:
    """`test` for a seeded share of the ids (in steps of 1/256), else `train`."""
    limit = format(round(test_share * 256), "02x")
    return F.when(F.substring(seeded_hash(key, seed), 1, 2) < limit, "test").otherwise("train")


def split_train_test(df: DataFrame, key: str = "encounter_id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("split", train_or_test(F.col(key), test_share, seed))


def sample_rows(df: DataFrame, n: int, key: str = "encounter_id", seed: int = 42) -> DataFrame:
    """n rows in seeded random order; each task keeps its own n before they meet."""
    return df.withColumn("_h", seeded_hash(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def shuffle_rows(df: DataFrame, key: str = "encounter_id", seed: int = 42) -> DataFrame:
    """Rows with their features and label in one seeded random order, `position` counting from 0.

    The position is a running count over hash ranges, so no task sees all rows.
    """
    hashed = df.withColumn("_h", F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 12), 16, 10).cast("long"))
    hashed = hashed.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(1))
    n_buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    splits = [i * 2.0**48 / n_buckets for i in range(1, n_buckets)]
    placed = running_totals(hashed, ["_all"], "_h", ["_one"], ties=[key], splits=splits)
    return placed.withColumn("position", F.col("_one_before").cast("long")).drop("_h", "_one", "_all", "_one_before")


