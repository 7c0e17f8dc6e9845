"""One function per registered query: `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspan.catalog import fixed
from wardspan.functions.stats import wilson_bounds
from wardspan.functions.text import coerce_numeric, format_auc_ci, format_percent_ci, parse_ci, strip_censor
from wardspan.operators import curves, explain, filters, harmonise, matching, metrics, params, prepare, report, synchronous
from wardspan.operators.logistic import lr_curvature, lr_gradient, lr_local_fit, newton_direction
from wardspan.operators.scale import local_table, pin_small
from wardspan.operators.scoring import score_rows, threshold_label
from wardspan.plans import bundle as bundles
from wardspan.plans import cohorts, extracts, federate
from wardspan.plans.cohorts import Prepared
from wardspan.sources.encounters import (
    CONTROL_BEFORE,
    EXTERNAL_SITE,
    SCALE_SITE,
    SITES,
    TRAIN_UNTIL,
    encounters,
    order_settings,
    table,
)
from wardspan.session import new_stage_path, write_stage
from wardspan.sources.raw import apply_correction, union_eras
from wardspan.sources.store import RunStore
from wardspan.specs import (
    DEVICE_FLOW_LEVELS,
    DEVICE_MASK_LEVELS,
    DEVICE_O2_LEVELS,
    DEVICE_TEXT_INVALID,
    DEVICE_TEXT_LEVELS,
    DISPLAY_NAMES,
    DUAL_SITE_COLUMNS,
    DUAL_SITE_DROPPED,
    ORDER_FEATURES,
    OUTCOME_COLUMN,
    OUTCOME_FLAGS,
    OUTCOME_FLAGS_DEATH_4,
    OUTCOME_SITE_COLUMNS,
    PCR_COLUMN,
    PERIOD_SITE_COLUMNS,
    SECOND_ASSAY_COLUMN,
    SEX_COLUMN,
    level_map,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATURES = ORDER_FEATURES
SETTINGS = order_settings()
FIT_SITES = [s.name for s in SITES if s.fits]
ALL_SITES = [s.name for s in SITES]


def query(function):
    """Register under the function's name, without the underscore that sets it apart from an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, negative zero as zero."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in doubles})


def pick(values: Sequence[str], place: Column) -> Column:
    """The list entry at `place` modulo the list's length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumnRenamed("o_orderkey", "encounter_id")


def key() -> Column:
    return F.col("encounter_id")


# ---- scans and sources


@query
def scan_encounters(spark, sf):
    return rounded(encounters(spark, sf).drop("avg_price", "avg_discount", "avg_tax"))


@query
def scan_union_eras(spark, sf):
    rows = encounters(spark, sf).select("encounter_id", "site", "arrival_ts", "label")
    earlier = filters.control_cohort(rows, CONTROL_BEFORE).drop("label")
    return union_eras(earlier, filters.filter_window(rows, CONTROL_BEFORE))


@query
def apply_correction_(spark, sf):
    current = encounters(spark, sf).select("encounter_id", "label")
    code = F.when(key() % 10 == 9, 9).otherwise(key() % 2).cast("string")
    correction = orders(spark, sf).where(key() % 3 != 0).select(key().cast("string").alias("epis_sg2"), code.alias("pcr_result48"))
    return apply_correction(current, correction).select("encounter_id", "label", "correction_found")


def _extract_files(spark, sf) -> list[extracts.Extract]:
    """CSV files of the four kinds, a quarter of the orders each; every 53rd order leaves a broken line instead."""
    root, rows = new_stage_path(spark, "csv"), orders(spark, sf).withColumn("q", F.floor(key() / 4))
    value, q = (key() % 97 + 1).cast("string"), F.col("q")
    date = F.when(q % 41 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    ethnicity = pick(["A", "Other-Chinese", "D", "elsewhere"], q)
    layouts = {
        "common": dict.fromkeys(DISPLAY_NAMES.values(), value)
        | {
            "ClusterID": key(),
            "ArrivalDateTime": date,
            "Ethnicity": ethnicity,
            "Vital_Sign Delivery device used": F.when(q % 29 == 0, "tent").otherwise((q % 4).cast("string")),
            "Covid-19 Positive": q % 2,
        },
        "outcome": dict.fromkeys(OUTCOME_SITE_COLUMNS, value)
        | {
            "PresentationID (unique identifier)": key(),
            "PresentationDate": date,
            "EthnicityCode": ethnicity,
            "AdmissionOxygenDeliveryDevice": F.when(q % 5 != 4, pick(["NV", "CPAP", "96", "tent"], q)),
            "PresentationALT": F.concat(F.lit("<"), value),
            OUTCOME_COLUMN: q % 4,
            PCR_COLUMN: q % 3,
            SECOND_ASSAY_COLUMN: F.when(q % 7 == 0, 1),
        },
        "period": dict.fromkeys(PERIOD_SITE_COLUMNS, value)
        | {
            "StudyID": key(),
            "period": pick(["pandemic", "pre-pandemic", "later"], q),
            "Ethnicity": ethnicity,
            SEX_COLUMN: q % 2,
            "AdmissionOxygenDeliveryDevice": pick(["O2HFN", "O2NASAL", "steam"], q),
            PCR_COLUMN: pick(["NOT Detected", "**DETECTED**", "Requested", "***DETECTED***"], q),
            OUTCOME_COLUMN: q % 5,
            "admitted AMU": F.when(q % 3 == 0, 1).otherwise(0),
            "subsequently attended AMU": F.lit(None),
        },
        "dual": dict.fromkeys([*DUAL_SITE_COLUMNS, *DUAL_SITE_DROPPED], value)
        | {
            "epis_sg2": key(),
            "YY": F.year("o_orderdate"),
            "MM": F.when(q % 41 == 0, 13).otherwise(F.month("o_orderdate")),
            "ethnic_origin": ethnicity,
            "ED O2 Flowrate": F.when(q % 4 != 3, pick(["2 l/min", "steam", "60%"], q)),
            "oxygen_mask": F.lit("5"),
            "ED Pulse": F.when(q % 2 == 0, value),
            "pcr_result": q % 2,
        },
    }

    def write(name: str, chosen: DataFrame, columns: dict) -> str:
        path = f"{root}/{name}"
        whole, broken = key() % 53 != 0, key() % 53 == 0
        chosen.where(whole).select(*[F.lit(c).cast("string").alias(n) if not isinstance(c, Column) else c.cast("string").alias(n) for n, c in columns.items()]).write.option("header", True).csv(path)
        chosen.where(broken).select(F.concat(F.lit("broken"), key().cast("string")).alias("x")).write.mode("append").option("header", True).csv(path)
        return path

    made = []
    for i, kind in enumerate(("common", "outcome", "period")):
        made.append(extracts.Extract(kind, kind, write(kind, rows.where(key() % 4 == i), layouts[kind])))
    dual, earlier = rows.where(key() % 4 == 3), {n: c for n, c in layouts["dual"].items() if n != "pcr_result"}
    before, current = write("before", dual.where(q % 3 == 0), earlier), write("dual", dual.where(q % 3 != 0), layouts["dual"])
    named = dual.where(q % 3 != 0).where(q % 5 != 0).select(
        F.when(q % 7 == 0, F.concat(F.lit("x"), key().cast("string"))).otherwise(key().cast("string")).alias("epis_sg2"),
        F.when(q % 11 == 0, 9).otherwise(q % 2).alias("pcr_result48"),
    )
    named.write.option("header", True).csv(f"{root}/correction")
    return [*made, extracts.Extract("dual", "dual", current, before, f"{root}/correction")]


@query
def quality_ledger(spark, sf):
    return extracts.harmonise_extracts(spark, _extract_files(spark, sf)).ledger


@query
def harmonise_extracts(spark, sf):
    found = extracts.harmonise_extracts(spark, _extract_files(spark, sf)).encounters
    kept = ["encounter_id", "site", "arrival_ts", "gender", "ethnicity", "vital_oxygen_device", "vital_heart_rate", "blood_alt", "discharged", "admission", "icu", "death", "label"]
    return rounded(found.select(*kept))


# ---- renames, recodes, cleaning


@query
def rename_standardise(spark, sf):
    raw = encounters(spark, sf).select(
        key().alias("epis_sg2"),
        F.col("age").alias("adm_age"),
        "gender",
        F.col("ethnicity").alias("ethnic_origin"),
        F.col("sum_qty").alias("HB"),
        F.col("total_price").alias("CRP"),
        F.col("n_lines").alias("DDIM"),
        F.col("icu").alias("ICU_adm"),
    )
    mapping = {"epis_sg2": "encounter_id", "adm_age": "age", "ethnic_origin": "ethnicity", "HB": "blood_haemoglobin", "CRP": "blood_crp", "ICU_adm": "icu"}
    return rounded(harmonise.rename_standardise(harmonise.drop_unused(raw, ["DDIM"]), mapping))


@query
def project_mapped(spark, sf):
    mapping = {"encounter_id": "ClusterID", "arrival_ts": "ArrivalDateTime", "n_lines": "vital_heart_rate", "sum_qty": "vital_oxygen_saturation"}
    return rounded(harmonise.project_mapped(encounters(spark, sf), mapping))


@query
def coalesce_dual_source(spark, sf):
    raw = encounters(spark, sf).select(
        "encounter_id",
        F.when(key() % 5 != 0, F.col("sum_qty")).alias("ED Pulse"),
        F.col("total_price").alias("pulse"),
        F.col("avg_discount").alias("ED sats"),
        F.when(key() % 2 == 0, F.col("n_lines")).alias("sats"),
    )
    merged = harmonise.coalesce_dual_source(raw, {"ED Pulse": "pulse", "ED sats": "sats"})
    return rounded(merged.select("encounter_id", F.col("ED Pulse").alias("heart_rate"), F.col("ED sats").alias("saturation")))


@query
def date_from_parts(spark, sf):
    stamp = harmonise.first_of_month(F.year("o_orderdate"), F.month("o_orderdate"))
    return orders(spark, sf).select("encounter_id", stamp.cast("timestamp_ntz").alias("arrival_ts"))


@query
def parse_arrival(spark, sf):
    text = (
        F.when(key() % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(key() % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise("not recorded")
    )
    return orders(spark, sf).select("encounter_id", harmonise.parse_arrival(text).cast("timestamp_ntz").alias("arrival_ts"))


@query
def period_to_date(spark, sf):
    label = F.when(F.col("o_orderdate") < filters.at_time(orders(spark, sf), "o_orderdate", CONTROL_BEFORE), "pre-pandemic").otherwise("pandemic")
    label = F.when(key() % 7 != 0, label)
    return orders(spark, sf).select("encounter_id", harmonise.period_to_date(label).cast("timestamp_ntz").alias("arrival_ts"))


@query
def recode_codes(spark, sf):
    code = pick(fixed.ETHNIC_TEXTS, key())
    return orders(spark, sf).select("encounter_id", code.alias("code"), harmonise.harmonise_ethnicity(code).alias("ethnicity"))


@query
def device_level(spark, sf):
    def some(values):
        return F.when(key() % 9 != 0, pick(values, key()))

    flow = harmonise.device_level(some(fixed.DEVICE_FLOW_TEXTS), level_map(DEVICE_FLOW_LEVELS, DEVICE_MASK_LEVELS), None)
    mask = harmonise.device_level((key() % 30).cast("string"), level_map(DEVICE_MASK_LEVELS), None)
    return orders(spark, sf).select(
        "encounter_id",
        harmonise.device_level(some(fixed.DEVICE_TEXTS), level_map(DEVICE_TEXT_LEVELS), 0, DEVICE_TEXT_INVALID).alias("text_level"),
        harmonise.device_level(some(fixed.DEVICE_O2_TEXTS), level_map(DEVICE_O2_LEVELS)).alias("o2_level"),
        F.coalesce(flow, mask).alias("flow_level"),
    )


@query
def outcome_flags(spark, sf):
    raw = orders(spark, sf).select("encounter_id", (key() % 4).alias("outcome"), F.when(key() % 4 == 3, 4).otherwise(key() % 4).alias("outcome4"))
    four = harmonise.outcome_flags(raw, "outcome", OUTCOME_FLAGS)
    renamed = four.withColumnsRenamed({n: f"{n}_a" for n in OUTCOME_FLAGS.values()})
    return harmonise.outcome_flags(renamed, "outcome4", OUTCOME_FLAGS_DEATH_4).drop("outcome", "outcome4")


@query
def admission_rule(spark, sf):
    flags = [F.when(key() % 5 != 0, (key() % 3 == 0).cast("int")), (key() % 7 == 0).cast("int"), (key() % 4 == 2).cast("int")]
    admitted = harmonise.admission_rule(flags)
    return orders(spark, sf).select("encounter_id", harmonise.episode_id(admitted, key()).alias("episode_id"), admitted.alias("admission"))


@query
def label_from_tests(spark, sf):
    first, second = F.when(key() % 4 != 0, (key() % 3).cast("int")), F.when(key() % 5 != 0, (key() % 2 + 1).cast("int"))
    return orders(spark, sf).select("encounter_id", harmonise.label_from_tests(first, second).alias("label"))


@query
def label_from_text(spark, sf):
    text = F.when(key() % 6 != 0, pick(fixed.ASSAY_TEXTS, key()))
    return orders(spark, sf).select("encounter_id", harmonise.label_from_text(text).alias("label"), F.lit(1).alias("admission"))


@query
def recode_sex(spark, sf):
    code = pick(["1", "0", "1.0", "X"], key())
    return orders(spark, sf).select("encounter_id", harmonise.sex_text(code).alias("gender"))


def _lab_texts(spark, sf) -> DataFrame:
    whole = F.col("sum_qty").cast("bigint").cast("string")
    return encounters(spark, sf).select(
        "encounter_id",
        F.when(key() % 13 == 0, "n/a").when(key() % 7 == 0, F.concat(F.lit("<"), whole)).when(key() % 5 == 0, F.concat(F.lit(">"), whole)).otherwise(whole).alias("lab"),
        F.concat(F.lit("a<b>"), F.col("gender")).alias("note"),
    )


@query
def strip_censor_(spark, sf):
    return strip_censor(_lab_texts(spark, sf))


@query
def coerce_numeric_(spark, sf):
    return coerce_numeric(strip_censor(_lab_texts(spark, sf), ["lab"]), ["lab"]).drop("note")


# ---- filters


@query
def filter_admitted(spark, sf):
    return filters.filter_admitted(encounters(spark, sf)).select("encounter_id", "site", "admission", "icu")


@query
def filter_window(spark, sf):
    rows = encounters(spark, sf).select("encounter_id", "site", "arrival_ts")
    return filters.filter_window(rows, "1996-03-01", TRAIN_UNTIL)


@query
def split_eras(spark, sf):
    before, after = filters.split_eras(encounters(spark, sf).select("encounter_id", "arrival_ts"), CONTROL_BEFORE)
    return before.withColumn("era", F.lit("before")).unionByName(after.withColumn("era", F.lit("after")))


@query
def filter_tested(spark, sf):
    return filters.filter_tested(encounters(spark, sf).select("encounter_id", "site", "label"))


@query
def dedupe_rows(spark, sf):
    return filters.dedupe_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query
def drop_all_missing(spark, sf):
    rows = filters.drop_all_missing(encounters(spark, sf), ["sum_qty", "avg_price", "max_price"])
    return rounded(rows.select("encounter_id", "sum_qty", "max_price"))


@query
def drop_thresh_missing(spark, sf):
    columns = ["sum_qty", "avg_price", "max_price", "avg_discount", "avg_tax", "n_lines"]
    return filters.drop_thresh_missing(encounters(spark, sf), columns, 5).select("encounter_id", "site")


@query
def select_feature_set(spark, sf):
    return rounded(filters.select_feature_set(encounters(spark, sf), "Orders"))


# ---- cohorts and matching


def _training(spark, sf) -> DataFrame:
    return cohorts.training_rows(encounters(spark, sf), SETTINGS)


def _training_people(spark, sf) -> DataFrame:
    """Training rows without features, written once for queries that read them several times."""
    columns = ["encounter_id", "site", "gender", "ethnicity", "age", "label", "arrival_ts"]
    return write_stage(_training(spark, sf).select(*columns), "training")


@query
def case_cohort(spark, sf):
    return filters.case_cohort(_training(spark, sf)).select("encounter_id", "site", "age", "gender", "ethnicity")


@query
def control_cohort(spark, sf):
    return filters.control_cohort(_training(spark, sf), CONTROL_BEFORE).select("encounter_id", "site", "age", "gender", "ethnicity")


@query
def cohort_union(spark, sf):
    rows = _training_people(spark, sf)
    both = filters.cohort_union(filters.case_cohort(rows), filters.control_cohort(rows, CONTROL_BEFORE))
    return both.groupBy("site", "label").agg(F.count("*").alias("n"))


@query
def match_candidates(spark, sf):
    rows = _training_people(spark, sf)
    found = matching.match_candidates(filters.case_cohort(rows), filters.control_cohort(rows, CONTROL_BEFORE))
    return found.select("case_id", "site", "n_candidates")


def _matched(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _training_people(spark, sf)
    cases, controls = filters.case_cohort(rows), filters.control_cohort(rows, CONTROL_BEFORE)
    return cases, controls, matching.match_controls(cases, controls, SETTINGS.match_ratio)


@query
def match_controls(spark, sf):
    return _matched(spark, sf)[2]


@query
def match_invariants(spark, sf):
    """Violations per site: reused controls, overfull cases, broken bands, free controls left to short cases."""
    cases, controls, pairs = _matched(spark, sf)
    k = SETTINGS.match_ratio
    columns = ["gender", "ethnicity", "age"]
    paired = pairs.join(
        controls.select("site", F.col("encounter_id").alias("control_id"), *[F.col(c).alias(f"c_{c}") for c in columns]), ["site", "control_id"]
    ).join(cases.select("site", F.col("encounter_id").alias("case_id"), *columns), ["site", "case_id"])
    same = (F.col("gender") == F.col("c_gender")) & (F.col("ethnicity") == F.col("c_ethnicity"))
    band = matching.in_band("c_age", "age", SETTINGS.age_band)
    broken = paired.groupBy("site").agg(F.count_if(~(same & band)).alias("n_out_of_band"))
    reused = paired.groupBy("site", "control_id").agg(F.count("*").alias("n")).groupBy("site").agg(F.count_if(F.col("n") > 1).alias("n_reused"))
    sizes = pairs.groupBy(F.col("case_id").alias("encounter_id")).agg(F.count("*").alias("n_matched"))
    filled = cases.join(sizes, "encounter_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    over = filled.groupBy("site").agg(F.count_if(F.col("n_matched") > k).alias("n_overfull"))
    free = controls.join(pairs.select(F.col("control_id").alias("encounter_id")), "encounter_id", "left_anti")
    open_slots = matching.match_candidates(filled.where(F.col("n_matched") < k), free)
    left = open_slots.groupBy("site").agg(F.sum("n_candidates").alias("n_free"))
    joined = over.join(broken, "site", "left").join(reused, "site", "left").join(left, "site", "left")
    return joined.fillna(0, ["n_out_of_band", "n_reused", "n_free"])


# ---- statistics and preparation


def _cohort(spark, sf) -> DataFrame:
    """Cases and all controls, written once because the statistics read them twice more."""
    marked = cohorts.case_control_set(cohorts.assign_roles(encounters(spark, sf), SETTINGS), SETTINGS, matched=False)
    return write_stage(marked.where("fits").select("encounter_id", "site", "label", *FEATURES), "cohort")


def _stats(spark, sf) -> DataFrame:
    return prepare.site_stats(_cohort(spark, sf), FEATURES)


@query
def site_medians(spark, sf):
    return rounded(_stats(spark, sf).select("site", "feature", "median", "n_nonnull"))


@query
def mean_of_medians(spark, sf):
    return rounded(prepare.mean_of_medians(_stats(spark, sf)))


@query
def site_minmax(spark, sf):
    return rounded(prepare.site_minmax(_stats(spark, sf)))


@query
def impute_site(spark, sf):
    cohort = _cohort(spark, sf)
    return rounded(prepare.impute_site(cohort, prepare.site_stats(cohort, FEATURES), FEATURES))


@query
def impute_mean(spark, sf):
    cohort = _cohort(spark, sf)
    return rounded(prepare.impute_site(cohort, prepare.site_stats(cohort, FEATURES), FEATURES, "mean"))


def _external(spark, sf) -> DataFrame:
    return cohorts.validation_rows(encounters(spark, sf), SETTINGS, fits=False).select("encounter_id", "site", "label", *FEATURES)


@query
def impute_federated(spark, sf):
    return rounded(prepare.impute_federated(_external(spark, sf), prepare.mean_of_medians(_stats(spark, sf)), FEATURES))


@query
def minmax_scale(spark, sf):
    cohort = _cohort(spark, sf)
    stats = prepare.site_stats(cohort, FEATURES)
    return rounded(prepare.minmax_scale(prepare.impute_site(cohort, stats, FEATURES), stats, FEATURES))


@query
def scale_foreign(spark, sf):
    stats = _stats(spark, sf)
    filled = prepare.impute_federated(_external(spark, sf), prepare.mean_of_medians(stats), FEATURES)
    return rounded(prepare.scale_foreign(filled, stats, FEATURES, SCALE_SITE))


def _prepared(spark, sf) -> DataFrame:
    return _prepared_store(spark, sf).rows


@query
def split_train_test(spark, sf):
    rows = cohorts.assign_roles(encounters(spark, sf), SETTINGS).where("role is not null")
    return prepare.split_train_test(rows).select("encounter_id", "site", "split")


@query
def cohort_counts(spark, sf):
    return filters.cohort_counts(_prepared(spark, sf))


@query
def sample_rows(spark, sf):
    return rounded(prepare.sample_rows(encounters(spark, sf).select("encounter_id", "site", "total_price"), 400))


@query
def shuffle_rows(spark, sf):
    return prepare.shuffle_rows(encounters(spark, sf).select("encounter_id", "label"))


# ---- scores


def _lr_params(spark) -> DataFrame:
    return federate.fixed_params(spark, "LR", fixed.LR_W)


def _nn_params(spark) -> DataFrame:
    return federate.fixed_params(spark, "NN", fixed.NN_W)


def _scored(spark, sf, splits=("test", "validation")) -> DataFrame:
    rows = _prepared(spark, sf).where(F.col("split").isin(*splits))
    return score_rows(rows, _lr_params(spark), "LR", FEATURES).select("encounter_id", "site", "split", "label", "p")


def _tied(spark, sf, splits=("test", "validation")) -> DataFrame:
    """Scores in thousandths, so that many of them tie."""
    return _scored(spark, sf, splits).withColumn("p", F.round("p", 3))


@query
def sigmoid_score(spark, sf):
    return rounded(_scored(spark, sf, ("train", "test", "validation", "external")))


@query
def mlp_score(spark, sf):
    rows = _prepared(spark, sf)
    return rounded(score_rows(rows, _nn_params(spark), "NN", FEATURES, hidden=fixed.HIDDEN).select("encounter_id", "site", "split", "p"))


@query
def threshold_label_(spark, sf):
    return _scored(spark, sf).select("encounter_id", "site", "split", threshold_label(F.col("p"), F.lit(0.25)).alias("predicted"))


@query
def confusion(spark, sf):
    return rounded(metrics.confusion(_scored(spark, sf).withColumn("threshold", F.lit(0.25)), ["site", "split"]))


@query
def log_loss(spark, sf):
    return rounded(metrics.log_loss(_scored(spark, sf), ["site", "split"]))


# ---- ranks, curves, intervals


@query
def midrank(spark, sf):
    return rounded(curves.midrank(_tied(spark, sf), ["site", "split"]))


def _weighted(spark, sf) -> DataFrame:
    return _tied(spark, sf).withColumn("weight", 1 + (key() % 4) / 2.0)


@query
def midrank_weighted(spark, sf):
    return rounded(curves.midrank_weighted(_weighted(spark, sf), ["site", "split"]))


@query
def delong_weighted(spark, sf):
    return rounded(curves.delong_weighted(_weighted(spark, sf), ["site", "split"]), 8)


@query
def roc_curve(spark, sf):
    return rounded(curves.roc_curve(_tied(spark, sf), ["site", "split"]))


@query
def delong_auc(spark, sf):
    return rounded(curves.delong_auc(_tied(spark, sf), ["site", "split"]), 8)


@query
def midrank_unrounded(spark, sf):
    return rounded(curves.midrank(_scored(spark, sf), ["site", "split"]))


@query
def roc_curve_unrounded(spark, sf):
    return rounded(curves.roc_curve(_scored(spark, sf), ["site", "split"]))


@query
def delong_auc_unrounded(spark, sf):
    return rounded(curves.delong_auc(_scored(spark, sf), ["site", "split"]), 8)


@query
def auc_ci(spark, sf):
    return rounded(curves.auc_ci(_tied(spark, sf), ["site", "split"]).drop("auc_var"))


def _paired_unrounded(spark, sf) -> DataFrame:
    rows = _prepared(spark, sf).where(F.col("split").isin("test", "validation"))
    one = score_rows(rows, _lr_params(spark), "LR", FEATURES, name="p1")
    two = score_rows(one, _nn_params(spark), "NN", FEATURES, hidden=fixed.HIDDEN, name="p2")
    return two.select("encounter_id", "site", "split", "label", "p1", "p2")


def _paired(spark, sf) -> DataFrame:
    """Both scores in thousandths, so that many of them tie."""
    return _paired_unrounded(spark, sf).withColumns({"p1": F.round("p1", 3), "p2": F.round("p2", 3)})


@query
def delong_test(spark, sf):
    tested = curves.delong_test(_paired(spark, sf), ["site", "split"])
    return rounded(tested.select("site", "split", "auc1", "auc2", "z", "p_value"))


@query
def delong_test_unrounded(spark, sf):
    tested = curves.delong_test(_paired_unrounded(spark, sf), ["site", "split"])
    return rounded(tested.select("site", "split", "auc1", "auc2", "z", "p_value"))


@query
def mcnemar_exact(spark, sf):
    rows = _paired(spark, sf).withColumns({"pred1": threshold_label(F.col("p1"), F.lit(0.25)), "pred2": threshold_label(F.col("p2"), F.lit(0.6))})
    return rounded(metrics.mcnemar_exact(rows, ["site", "split"]), 8)


@query
def ground_truth_order(spark, sf):
    return curves.ground_truth(_prepared(spark, sf), ["site", "split"])


@query
def wilson_ci(spark, sf):
    rows = encounters(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.sum("death").alias("hits"))
    low, high = wilson_bounds("hits", "n")
    return rounded(rows.withColumns({"low": low, "high": high}))


@query
def sens_spec_ci(spark, sf):
    return rounded(metrics.sens_spec_ci(_scored(spark, sf).withColumn("threshold", F.lit(0.25)), ["site", "split"]))


@query
def threshold_sweep(spark, sf):
    scores = _tied(spark, sf, ("test",))
    swept = metrics.threshold_sweep(scores, ["site"])
    auc = curves.delong_auc(scores, ["site"]).select("site", "auc")
    return rounded(swept.join(auc, "site"))


@query
def best_threshold(spark, sf):
    sweep = metrics.threshold_sweep(_tied(spark, sf, ("test",)), ["site"])
    parts = [
        metrics.best_threshold(sweep, ["site"], metric, target).withColumn("metric", F.lit(metric))
        for metric, target in (("recall", 0.85), ("precision", 0.3), ("f1", 0.4))
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def mean_threshold(spark, sf):
    best = metrics.calibrate(_tied(spark, sf, ("test",)), ["site"]).select("site", "threshold")
    outside = local_table(spark, [{"site": EXTERNAL_SITE, "threshold": None}], "site string, threshold double")
    return rounded(metrics.mean_threshold(best.unionByName(outside)))


def _evaluated(spark, sf, given=_tied) -> DataFrame:
    scores = given(spark, sf)
    thresholds = metrics.calibrate(scores.where(F.col("split") == "test"), ["site"])
    return metrics.evaluate_model(scores, thresholds, ["site", "split"])


@query
def evaluate_model(spark, sf):
    return rounded(_evaluated(spark, sf))


@query
def evaluate_model_unrounded(spark, sf):
    return rounded(_evaluated(spark, sf, _scored))


@query
def format_ci(spark, sf):
    row = _evaluated(spark, sf)
    texts = {r: format_percent_ci(F.col(r), F.col(f"{r}_lo"), F.col(f"{r}_hi")) for r in ("sensitivity", "specificity")}
    auc = format_auc_ci(F.round("auc", 2), F.col("auc_lo"), F.col("auc_hi"))
    return row.select("site", "split", *[c.alias(f"{r}_text") for r, c in texts.items()], auc.alias("auc_text"))


@query
def parse_ci_(spark, sf):
    priority = F.element_at(F.split("o_orderpriority", "-"), 1).cast("int")
    text = F.when(key() % 17 == 0, "not reported").otherwise(
        F.concat(
            F.lit("0."), (key() % 97 + 1).cast("string"), F.when(key() % 2 == 0, "%").otherwise(""), F.lit(" (0."), priority.cast("string"),
            F.lit(" - "), (key() % 89).cast("string"), F.lit(")"),
        )
    )
    point, low, high = parse_ci(text)
    return rounded(orders(spark, sf).select("encounter_id", point.alias("point"), low.alias("low"), high.alias("high")))


@query
def message_json(spark, sf):
    """Round messages as JSON and back."""
    counts = encounters(spark, sf).groupBy("site").agg(F.count("*").alias("n"), F.sum("icu").alias("n_icu"), F.min("encounter_id").alias("first_id"))
    message = F.to_json(F.struct("n", "n_icu", F.create_map(F.lit("first"), F.col("first_id")).alias("ids")))
    back = F.from_json("message", "n bigint, n_icu bigint, ids map<string, bigint>")
    return counts.select("site", message.alias("message")).select("site", "message", back["n"].alias("n"), back["ids"]["first"].alias("first_id"))


# ---- federated operators


def _mean_params(spark, sf) -> DataFrame:
    """Parameters standing for local fits: each site's feature means and its number of training rows."""
    train = _prepared(spark, sf).where(F.col("split") == "train")
    return train.groupBy("site").agg(F.count("*").alias("n_train"), F.array(*[F.avg(f) for f in FEATURES]).alias("w")).select(
        F.lit("LR").alias("model"), "site", F.lit(1).alias("round"), "n_train", "w"
    )


@query
def init_params(spark, sf):
    zero = params.init_params(encounters(spark, sf), len(FEATURES))
    return zero.select("model", "site", "round", "n_train", F.posexplode("w").alias("idx", "value"))


@query
def fedavg_params(spark, sf):
    return rounded(params.fedavg_params(_mean_params(spark, sf)).drop("n_train"))


@query
def fedavg_loss(spark, sf):
    losses = metrics.log_loss(_scored(spark, sf, ("validation",)), ["site"]).withColumns({"model": F.lit("LR"), "round": F.lit(1)})
    return rounded(params.fedavg_loss(losses))


def _site_params(spark) -> DataFrame:
    """A different fixed vector for every fitting site."""
    rows = [
        {"model": "LR", "site": s, "round": 1, "n_train": 1, "w": [v * (i + 1) / 4 for v in fixed.LR_W]}
        for i, s in enumerate(FIT_SITES)
    ]
    return params.params_table(spark, rows)


@query
def lr_gradient_(spark, sf):
    train = _prepared(spark, sf).where(F.col("split") == "train")
    found = lr_gradient(train, _site_params(spark), FEATURES)
    return rounded(found.select("site", "n", "loss", F.posexplode("gradient").alias("idx", "value")))


def _curvature(spark, sf) -> DataFrame:
    points = {(row["site"], row["round"]): row["w"] for row in _site_params(spark).collect()}
    return lr_curvature(_prepared(spark, sf).where(F.col("split") == "train"), points, FEATURES)


@query
def lr_curvature_(spark, sf):
    """The upper triangle of every site's Hessian, row by row."""
    return rounded(_curvature(spark, sf).select("site", "n", "loss", F.posexplode("hessian").alias("idx", "value")), 5)


@query
def lr_newton_step(spark, sf):
    """Gradient and full Newton step of every site from its fixed vector."""
    steps = [
        {"site": row["site"], "n": row["n"], "gradient": row["gradient"], "step": newton_direction(row["gradient"], row["hessian"]).tolist()}
        for row in _curvature(spark, sf).collect()
    ]
    table = local_table(spark, steps, "site string, n long, gradient array<double>, step array<double>")
    pairs = F.posexplode(F.arrays_zip("gradient", "step")).alias("idx", "v")
    return rounded(table.select("site", "n", pairs).select("site", "n", "idx", "v.gradient", "v.step"), 5)


@query
def lr_local_fit_(spark, sf):
    train = _prepared_store(spark, sf).rows.where(F.col("split") == "train")
    fitted = lr_local_fit(train.persist(), {(s, 1): [0.0] * (len(FEATURES) + 1) for s in FIT_SITES}, FEATURES)
    return fitted.select("model", "site", "round", "n_train", F.posexplode("w").alias("idx", "value"))


def _prepared_store(spark, sf, matched: bool = False) -> Prepared:
    return cohorts.prepare(encounters(spark, sf), SETTINGS, matched=matched)


@query
def mlp_local_fit(spark, sf):
    start = federate.start_vector("NN", SETTINGS)
    fitted = federate.local_fit(_prepared(spark, sf), "NN", {(s, 1): start for s in FIT_SITES}, SETTINGS)
    return fitted.select("model", "site", "round", "n_train", F.posexplode("w").alias("idx", "value"))


@query
def mlp_gradient(spark, sf):
    """Loss and gradient of every site's network at a vector of its own: what the first step of a site-wide fit moves by."""
    start = {(s, 1): [v * (i + 1) / 4 for v in fixed.NN_W] for i, s in enumerate(FIT_SITES)}
    train = _prepared(spark, sf).where(F.col("split") == "train")
    found = synchronous.mlp_gradient(train, start, FEATURES, fixed.HIDDEN)
    return rounded(found.select("site", "n", "loss", F.posexplode("gradient").alias("idx", "value")))


@query
def mlp_site_fit(spark, sf):
    """One network per site in synchronous steps over all its training rows."""
    settings = order_settings(nn_solver="site")
    start = federate.start_vector("NN", settings)
    fitted = federate.local_fit(_prepared(spark, sf), "NN", {(s, 1): start for s in FIT_SITES}, settings)
    return fitted.select("model", "site", "round", "n_train", F.posexplode("w").alias("idx", "value"))


@query
def fedavg_round(spark, sf):
    """Three LR rounds and one NN round on the matched cohort."""
    settings = order_settings(lr_rounds=3, nn_rounds=1)
    run = federate.run_federation(_prepared_store(spark, sf, matched=True), settings, with_personalised=False, with_roc=False)
    return run.history(settings.lr_rounds)


@query
def personalise(spark, sf):
    rows = _prepared(spark, sf)
    applied = federate.calibrate_sites(rows, "LR", _lr_params(spark), SETTINGS)
    return federate.personalise(rows, applied, SETTINGS)[0]


@query
def federated_evaluate(spark, sf):
    rows = _prepared(spark, sf)
    first = federate.calibrate_sites(rows, "LR", federate.fixed_params(spark, "LR", fixed.round_weights("LR", 1)), SETTINGS)
    now = federate.calibrate_sites(rows, "LR", _lr_params(spark), SETTINGS)
    result = federate.federated_evaluate(rows, now, SETTINGS, baseline=first.at_round(1))
    return rounded(result.drop("p_lr_vs_nn", "auc_var"))


def _outside(spark, sf, split: str) -> DataFrame:
    rows = _prepared(spark, sf)
    result = federate.evaluate_external(rows, "LR", _lr_params(spark), {1: 0.25}, SETTINGS, only=[split])
    return rounded(result.drop("p_vs_round1", "p_lr_vs_nn", "auc_var"))


@query
def evaluate_external(spark, sf):
    return _outside(spark, sf, "external")


@query
def central_evaluate(spark, sf):
    return _outside(spark, sf, "central")


@query
def score_stored(spark, sf):
    """Publish a model bundle, read it in a new session and evaluate the outside site from its raw encounters."""
    prepared = _prepared_store(spark, sf)
    thresholds = local_table(spark, [{"model": "LR", "site": None, "round": 1, "threshold": 0.25}], bundles.TABLES["thresholds"])
    tables = {"stats": prepared.stats, "pooled": prepared.pooled, "params": _lr_params(spark), "thresholds": thresholds}
    root = new_stage_path(spark, "bundles")
    version = bundles.publish_bundle(spark, root, SETTINGS, tables)
    fresh = spark.newSession()
    stored = bundles.load_bundle(fresh, root, version)
    result = bundles.evaluate_stored(encounters(fresh, sf), stored, "LR", only=["external"])
    return rounded(result.drop("p_vs_round1", "p_lr_vs_nn", "auc_var"))


# ---- round histories and reports


SERIES = ["site", "model", "variant", "round"]


def _round_scores(spark, sf) -> DataFrame:
    """Scores of two models and two variants over three rounds of fixed parameters."""
    rows = _prepared(spark, sf).where(F.col("split").isin("test", "validation", "central"))
    keyed = rows.withColumn("round", F.explode(F.array(*[F.lit(r) for r in fixed.ROUNDS]))).withColumn(
        "variant", F.explode(F.array(F.lit("global"), F.lit("personalised")))
    )
    keyed = keyed.where((F.col("variant") == "global") | (F.col("split") != "central"))
    parts = []
    for model in ("LR", "NN"):
        vectors = [
            {"round": r, "variant": v, "w": fixed.round_weights(model, r, v == "personalised")}
            for r in fixed.ROUNDS
            for v in ("global", "personalised")
        ]
        parameters = local_table(spark, vectors, "round int, variant string, w array<double>")
        scored = score_rows(keyed, parameters, model, FEATURES, ["round", "variant"], fixed.HIDDEN)
        parts.append(scored.withColumn("model", F.lit(model)))
    both = parts[0].unionByName(parts[1])
    return both.select(*SERIES, "split", "encounter_id", "label", F.round("p", 3).alias("p"))


def _history(spark, sf) -> DataFrame:
    """Result rows of validation and central splits for all rounds."""
    scores = _round_scores(spark, sf)
    thresholds = metrics.calibrate(scores.where(F.col("split") == "test"), SERIES)
    judged = scores.where(F.col("split") == "validation")
    inside = metrics.evaluate_model(judged, thresholds, [*SERIES, "split"], SERIES)
    shared = metrics.mean_threshold(thresholds, ["model", "variant", "round"])
    central = scores.where(F.col("split") == "central")
    outside = metrics.evaluate_model(central, shared, [*SERIES, "split"], ["model", "variant", "round"])
    return pin_small(report.round_history([inside, outside]), "results")[0]


@query
def round_history(spark, sf):
    return rounded(report.continue_rounds(_history(spark, sf), len(fixed.ROUNDS)).drop("auc_var"))


@query
def run_tables(spark, sf):
    """The rounds of both models go through the tables of a run that stops after round 2 and goes on, then the history is read from them."""
    history, root = _history(spark, sf), new_stage_path(spark, "run")
    for stop in (2, len(fixed.ROUNDS)):
        store = RunStore(spark, root, SETTINGS)
        for model in ("LR", "NN"):
            of_model = history.where(F.col("model") == model)
            store.rounds("results", model, "all", fixed.ROUNDS[:stop], lambda r, rows=of_model: rows.where(F.col("round").isin(r)))
    stored = RunStore(spark, root, SETTINGS).read("results").drop("part")
    return rounded(report.continue_rounds(stored, len(fixed.ROUNDS)).drop("auc_var"))


@query
def round_index(spark, sf):
    rows = _history(spark, sf)
    return rounded(report.round_index(rows).select(*SERIES, "split", "round_index", "auc"))


@query
def first_last_round(spark, sf):
    return rounded(report.first_last_round(_history(spark, sf)))


@query
def align_rounds(spark, sf):
    rows = _history(spark, sf).where(F.col("variant") == "global").select("site", "model", "round", "auc")
    nn = rows.where("model = 'NN'").select("site", "round", F.col("auc").alias("nn_auc"))
    lr = rows.where("model = 'LR'").select("site", "round", F.col("auc").alias("lr_auc"))
    return rounded(report.align_rounds(nn, [lr], ("site", "round")))


@query
def results_by_site(spark, sf):
    rows = _history(spark, sf).where(F.col("variant") == "global")
    wide = report.results_by_site(rows, ALL_SITES, ["auc", "sensitivity", "fn"])
    return rounded(wide.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in wide.columns}))


@query
def summary_table(spark, sf):
    return rounded(report.summary_table(_history(spark, sf), [EXTERNAL_SITE]))


@query
def federation_curves(spark, sf):
    return rounded(report.federation_curves(_history(spark, sf)))


@query
def central_eval_table(spark, sf):
    return rounded(report.central_eval_table(_history(spark, sf), len(fixed.ROUNDS)))


def _round_roc(spark, sf) -> DataFrame:
    scores = _round_scores(spark, sf).where((F.col("variant") == "global") & (F.col("split") == "validation"))
    return curves.roc_curve(scores, ["site", "model", "round"])


@query
def roc_compare(spark, sf):
    return rounded(report.roc_compare(_round_roc(spark, sf)))


@query
def roc_by_site(spark, sf):
    wide = report.roc_by_site(_round_roc(spark, sf).where(F.col("round") == 3), FIT_SITES)
    return rounded(wide.withColumnsRenamed({c: c.lower() for c in wide.columns}))


# ---- explanations


@query
def feature_importance(spark, sf):
    averaged = params.fedavg_vectors(_mean_params(spark, sf))
    return rounded(explain.feature_importance(averaged, FEATURES))


def _linear_attributions(spark, sf) -> DataFrame:
    rows = _prepared(spark, sf).where(F.col("label") == 1)
    test, train = rows.where(F.col("split") == "test"), rows.where(F.col("split") == "train")
    return explain.shapley_linear(test, train, _site_params(spark), FEATURES)


@query
def shapley_linear(spark, sf):
    return rounded(_linear_attributions(spark, sf))


@query
def shap_summary(spark, sf):
    return rounded(explain.shap_summary(_linear_attributions(spark, sf), ["site"]))


@query
def shapley_sampled(spark, sf):
    """LR on every external row, the network on a seeded sample of them."""
    rows = _prepared_store(spark, sf).rows.where(F.col("split") == "central")
    linear = explain.shapley_sampled(rows, rows, fixed.LR_W, "LR", FEATURES)
    few = prepare.sample_rows(rows, SETTINGS.shap_explained)
    network = explain.shapley_sampled(few, rows, fixed.NN_W, "NN", FEATURES, fixed.HIDDEN, SETTINGS.shap_background, 2)
    return linear.unionByName(network)


@query
def shapley_exact(spark, sf):
    """LR on every central row, the network on a seeded sample of them."""
    rows = _prepared_store(spark, sf).rows.where(F.col("split") == "central")
    linear = explain.shapley_exact(rows, rows, fixed.LR_W, "LR", FEATURES)
    few = prepare.sample_rows(rows, SETTINGS.shap_explained)
    network = explain.shapley_exact(few, rows, fixed.NN_W, "NN", FEATURES, fixed.HIDDEN)
    return rounded(linear.unionByName(network))


# ---- the minimum slice


@query
def site_screening(spark, sf):
    """Impute, scale, score and judge every site's rows at one threshold."""
    scored = _scored(spark, sf, ("train", "test", "validation", "external", "central"))
    judged = metrics.confusion(scored.withColumn("threshold", F.lit(0.25)), ["site", "split"])
    return rounded(metrics.with_intervals(judged))
