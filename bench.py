"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. Each query
runs once to warm up and then BENCH_RUNS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from fusewright.operators.prox import compare_solvers, solve_scalar, solve_scalar_bisection  # noqa: E402
from fusewright.plans import catalog  # noqa: E402
from fusewright.sources.tables import SIZES, benchmark_problems  # noqa: E402

HEADLINE = (
    "flagship_fused_suppliers", "group_stats_supplier", "loc_median", "loc_trimmed_10", "loc_huber", "loc_lts", "pairs_dup_first", "pairs_dup_sum",
    "weights_adaptive_g1", "graph_adjacency_list", "graph_incidence", "build_graph_median", "encode_sorted", "prox_chain", "prox_lambda_path",
    "prox_benchmark_problems", "components", "components_supplier_chain",
)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    # as many solves a second as one job makes of 600 problems of 5 to 500 neighbours
    problems, nbrs = benchmark_problems(spark, 100)
    solve = lambda: solve_scalar(problems, nbrs, validate=False, largest=max(SIZES)).write.format("noop").mode("overwrite").save()
    solve()
    began = time.perf_counter()
    solve()
    took_closed = time.perf_counter() - began
    rate = round(600 / took_closed, 1)
    # the same problems by bisection, and how many the closed form solves as well
    began = time.perf_counter()
    solve_scalar_bisection(problems, nbrs).write.format("noop").mode("overwrite").save()
    speed_up = round((time.perf_counter() - began) / took_closed, 2)
    solved = sum(r["solved"] for r in compare_solvers(problems, nbrs).collect()) / 600
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "scalar_solves_per_sec": rate, "speed_up_over_bisection": speed_up, "success_rate": solved, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
