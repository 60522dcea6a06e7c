"""Headline timings: one warm-up, then the median of three runs to a noop sink.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores."""

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tidemark.catalogue import QUERIES, bases
from tidemark.catalogue.alignment import bounds
from tidemark.operators import align, contribution, lagged, stationarity, warping, window
from tidemark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def by_part(spark, stamp):
    """Total per part and period: many short series."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return bases.table(spark, SF_DIR, "lineitem").groupBy(
        F.col("l_partkey").cast("string").alias("series"), stamp.cast("date").alias("d")).agg(
        (F.sum(cents).cast("double") / bases.UNIT).alias("v"))


def gap_and_borrow(spark):
    aligned = align.align_weekly(by_part(spark, F.col("l_shipdate")), *bounds(spark, SF_DIR))
    return window.gap_report(aligned)


def contributions(spark):
    obs, w = bases.nations(spark, SF_DIR), bases.weights(spark, SF_DIR)
    return contribution.group_contributions(obs, w)


HEADLINES = {
    "weekly_summary": lambda s: QUERIES["summary_weekly"](s, SF_DIR),
    "gap_and_borrow_by_part": gap_and_borrow,
    "contributions": contributions,
    "lagged_correlation_12": lambda s: lagged.lagged_correlation(bases.sparse(s, SF_DIR), "S1", 12),
    "divergence_12": lambda s: lagged.lagged_divergence(bases.sparse(s, SF_DIR), "S1", 12),
    "warp_fan_out": lambda s: warping.warp_candidates(
        align.daily_to_weekly(bases.sparse(s, SF_DIR)).filter(F.col("v").isNotNull()), "S1", strict=False),
    "unit_root_by_part": lambda s: stationarity.test_stationarity(by_part(s, F.trunc("l_shipdate", "MM"))),
    "yoy_asof": lambda s: align.year_on_year(bases.sparse(s, SF_DIR)),
    "panel_preparation": lambda s: QUERIES["prepare_panel"](s, SF_DIR),
    "revision_contributions": lambda s: QUERIES["normalized_impacts"](s, SF_DIR),
    "contribution_ranks": lambda s: QUERIES["contribution_ranks"](s, SF_DIR),
    "principal_components": lambda s: QUERIES["principal_components"](s, SF_DIR),
}


def main():
    spark = local_session(CPUS, memory=os.environ.get("BENCH_MEMORY", "8g"))
    seconds = {}
    for name, build in HEADLINES.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            build(spark).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
