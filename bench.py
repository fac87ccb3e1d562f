"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["site_hourly", "mark_outliers", "missing_gaps", "lag_features", "rolling_features", "impute_median", "error_by_site", "rollup_hour_of_day", "filtered_kpi", "enrich_fact", "unpivot_wide", "linear_predictions"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ampline.queries import QUERIES

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first one warms up
            began = time.perf_counter()
            spark.catalog.clearCache()  # nothing that a run before has kept is read
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
