"""Times the queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS: data directory and threads. BENCH_QUERIES: comma-separated
subset. Every query is run once to warm up and then BENCH_REPEATS times (default 2); the
best time counts. Deriving the canonical tables is reported apart as "prepare".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from farewheel.plans.registry import JOB_QUERIES, TABLE_QUERIES, all_queries
from farewheel.sources.warehouse import tables_root

# Jobs that iterate or stream take seconds each and run once, without a warm-up.
ONCE = [
    "cluster_k_sweep", "cluster_profiles", "cluster_centres", "cluster_continuous", "cluster_labels", "cluster_projection",
    "persona_feature_profile", *JOB_QUERIES,
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("farewheel-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture for error messages costs as much as building a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    start = time.perf_counter()
    tables_root(spark, sf_dir)
    prepare = time.perf_counter() - start

    names = chosen.split(",") if chosen else [*[q for q in TABLE_QUERIES if q not in ONCE], *ONCE]
    times = {}
    for name in names:
        if name not in ONCE:
            run(name)
            times[name] = round(min(run(name) for _ in range(repeats)), 3)
        else:
            times[name] = round(run(name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "prepare": round(prepare, 3),
        "cpus": int(cpus),
    }))
    spark.stop()


main()
