"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog.all import QUERIES
from quoin.session import local_session

HEADLINE = (
    "building_eui",
    "monthly_energy_stats",
    "end_use_totals",
    "scenario_change_single_pass",
    "descriptive_summary",
    "eui_histogram",
    "results_with_locations",
    "drop_report",
    "rectangle_features",
    "neighbors_within_100m",
    "separate_neighbors",
    "shading_mask",
    "nearest_station",
    "feature_table",
    "preprocessed_buildings",
    "preprocessed_buildings_utm",
    "heat_index_hours",
    "exceedance_runs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
