"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardspan.catalog.queries import QUERIES  # noqa: E402
from wardspan.plans.cohorts import prepare  # noqa: E402
from wardspan.plans.federate import run_federation  # noqa: E402
from wardspan.session import build_session  # noqa: E402
from wardspan.sources.encounters import encounters, order_settings  # noqa: E402

HEADLINE = [
    "scan_encounters",
    "site_screening",
    "site_medians",
    "threshold_sweep",
    "roc_curve",
    "delong_auc",
    "delong_test",
    "evaluate_model",
    "match_candidates",
    "match_controls",
    "federated_evaluate",
    "lr_gradient",
    "shapley_linear",
    "summary_table",
]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def federation(spark, sf_dir, models) -> None:
    settings = order_settings()
    prepared = prepare(encounters(spark, sf_dir), settings, matched=False)
    run = run_federation(prepared, settings, models=models, with_personalised=False, with_roc=False)
    drain(run.history(settings.lr_rounds))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # small data: keep shuffle partitions for all cores
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or [*HEADLINE, "lr_rounds_15", "nn_rounds_15"]
    jobs = {
        "lr_rounds_15": lambda: federation(spark, sf_dir, ("LR",)),
        "nn_rounds_15": lambda: federation(spark, sf_dir, ("NN",)),
    }
    drain(QUERIES["site_screening"](spark, sf_dir))  # warm-up
    times = {}
    for name in names:
        job = jobs.get(name) or (lambda name=name: drain(QUERIES[name](spark, sf_dir)))
        times[name] = round(statistics.median(timed(job) for _ in range(RUNS)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    result = {"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
