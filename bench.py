"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8). Each query runs once over the
smallest tables first, so that start-up is not measured.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from outlay.plans import registry

HEADLINE = (
    "overview_kpis", "by_supplier_page", "by_category", "by_month_rolling3", "by_legal_entity", "abc_rows", "tail_flag", "concentration_hhi_pareto",
    "kpi_row", "diagnostics_a", "boxplot_stats", "rollup_l1_l2", "fx_exact_and_nearest", "category_cascade", "allocate_recommendations",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:
        for at in ("/root/testdata/sf0.001", sf_dir):
            began = time.time()
            queries[name](spark, at).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
