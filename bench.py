"""Wall time of the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from shelfcast.catalog import fixtures as fx
from shelfcast.catalog.queries import registered
from shelfcast.plans.features import build_features

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "panel_complete",
    "features_bounded",
    "missing_rates",
    "scores_all",
    "calibration_grid",
    "best_multiplier",
    "target_profile",
    "gap_audit",
    "store_heterogeneity",
    "promo_cycle",
    "vocabulary",
    "encoded",
    "leakage_report",
    "skew_report",
    "noise_floor",
    "serving_table",
    "request_status",
    "range_forecast",
    "range_summary",
    "classical_forecast",
    "supplier_scores_all",
    "supplier_features_rolling",
    "supplier_range_forecast",
    "gbt_scores",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("shelfcast-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='shelfcast-bench-')}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = registered()
    steps = {
        "daily_facts": lambda: fx.daily(spark, SF_DIR).count(),
        "features_full": lambda: run(
            build_features(fx.daily(spark, SF_DIR), fx.stores(spark, SF_DIR), fx.SPEC)
        ),
    }
    for name in HEADLINE:
        steps[name] = lambda name=name: run(queries[name](spark, SF_DIR))
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
