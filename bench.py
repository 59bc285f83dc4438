"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the sample tables, BENCH_CPUS the local threads, BENCH_RUNS how often each
query is timed after one untimed run; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from dealscope.plans.catalogue import CATALOGUE
from dealscope.session import local_session

HEADLINE = (
    "company_features",    # the feature job's plan: seven tables to one
    "company_base", "degree_counts", "extract_degrees",
    "split_stratified", "stratified_folds", "csv_roundtrip",
    "eda_corr", "eda_age_rate", "eda_category_rate", "eda_completeness", "eda_histograms",
    "funds_by_rounds", "robust_line", "one_hot", "feature_vector",
    "classification_metrics", "acquisition_chance",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    CATALOGUE[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "dealscope-bench")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
