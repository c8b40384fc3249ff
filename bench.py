"""Headline timings: prints one JSON line. Reads $BENCH_SF_DIR on local[$BENCH_CPUS].

``build_*`` entries time the steps of a full ledger run that write a table,
``q_*`` entries time registered queries executed in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lossledger.plans.catalog import all_queries
from lossledger.plans.driver_tables import tables

# In the order in which a run needs them.
STEPS = (
    "inverters plant readings error_intervals tickets tariffs error_catalog fleet eta features "
    "split curve fleet_curve holdout metrics models moments health slopes intervals raw "
    "degradation ledger"
).split()

QUERIES = (
    "q_unpivot_readings q_error_events q_fill_continuation q_inverters q_profile "
    "q_readings_with_context q_readings_monthly q_fleet q_eta q_physics_bands q_physics_monthly "
    "q_performance_ratio q_rolling_features q_training_rows q_twin_metrics q_twin_bands "
    "q_monthly_health q_theil_sen q_persistence q_error_context q_loss_intervals q_ledger_raw "
    "q_degradation_loss q_ledger_validated q_ticket_nearest q_ticket_lead q_by_year_cause "
    "q_kpis q_heatmap_pivot q_accounting q_service_priority q_worst_month"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lossledger-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    run = tables(spark, folder).run
    for step in STEPS:
        started = time.perf_counter()
        getattr(run, step)
        seconds[f"build_{step}"] = round(time.perf_counter() - started, 3)
    registered = all_queries()
    for name in QUERIES:
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "ledger_build_and_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
