"""Times the headline queries; prints one JSON line.

Each query runs twice and the second run counts: the first one loads classes and
compiles the generated code. All rows are computed, none are brought back.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roomtable.plans import catalog  # noqa: E402
from roomtable.session import local_session  # noqa: E402

HEADLINES = (
    "confusion_totals",
    "manifest_file_problems",
    "exposure_profile",
    "edge_width",
    "blur_reading",
    "geometric_floor",
    "mask_metrics",
    "boundary_metrics",
    "pair_agreement",
    "mask_components",
    "candidate_summary",
    "k1_fit",
    "lens_report",
    "vanishing_points",
    "floor_scale",
    "product_alternatives",
    "stage_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="roomtable-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
