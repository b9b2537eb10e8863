"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data directory, BENCH_CPUS the number of local cores, BENCH_RUNS
how often each query is timed after one warm-up (the best time counts).
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from checks.queries import QUERIES
from forecourt import build_session

HEADLINE = (
    "price_by_make",
    "filter_all_of",
    "search_contains",
    "stat_group",
    "stat_ordered",
    "stat_global_ranked",
    "agg_map_ranked",
    "chart_stat",
    "summary_all",
    "trim_range_1000",
    "dist_interval",
    "dist_quantile",
    "bin_stats",
    "price_bands",
    "pivoted",
    "pivot_series",
    "deals",
    "top_deals",
    "facet_make",
    "facet_models",
    "estimate",
    "estimate_relaxed",
    "estimate_alternative",
    "estimate_batch_engines",
    "estimate_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(min(times[1:] or times), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of runs after a warm-up, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
