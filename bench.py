"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the no-op sink (nothing is
collected): one cold run, then the median of $BENCH_RUNS warm runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ytd_store",                     # flagship: year-to-date growth per comparable store
    "yoy_store_family",              # store x family, re-summed, sum-pivot
    "report_grouping_sets",          # every grain in one GROUPING SETS pass
    "measures_long",                 # the long fact itself
    "join_export_all",               # register keep-first + closure buckets + join
    "briefing_consolidated_matrix",  # sector growth matrix
    "briefing_family_contribution",  # gap / growth / contribution
    "comparison_union",              # three-year monthly growth series
    "period_split_family",           # rolling-period briefing
    "history_growth_comparable",
    "operating_result",              # Sunday extended hours
    "share_long",                    # market-share unpivot
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from comparo import get_spark
    from comparo.catalog import QUERIES
    from comparo.plans import monthly
    from comparo.catalog import measures, YEARS, MONTH, MONTH_RANGES
    from comparo.sources import proxy as X

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    times, cold = {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        cold[name] = round(time.perf_counter() - t0, 3)
        warm = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            warm.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(warm), 3)

    # the twelve monthly tables over the same written cube: one roll-up vs twelve plans
    def report_set(one_pass: bool) -> float:
        t0 = time.perf_counter()
        reps = monthly.monthly_reports(measures(spark, sf_dir, ranges=MONTH_RANGES),
                                       X.register(spark, sf_dir),
                                       YEARS, MONTH, one_pass=one_pass, reuse="table")
        for df in reps.values():
            run(df)
        return round(time.perf_counter() - t0, 3)

    extra = {"monthly_set_one_pass": report_set(True),
             "monthly_set_separate": report_set(False)}
    from comparo.checks.plans import summary
    shape = summary(QUERIES["ytd_store"](spark, sf_dir))
    flagship_plan = {k: shape[k] for k in ("shuffles", "broadcasts", "smj", "windows", "python")}
    flagship_plan["months_picked_by_folder"] = any("month" in p for p in shape["partition_filters"])
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_warm_median",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "report_set": extra,
        "flagship_plan": flagship_plan,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
