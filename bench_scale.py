"""Times the jobs on many shifted copies of the sample tables, plain and with hot keys.

BENCH_COPIES sets how many copies (default 100), BENCH_SF_DIR and BENCH_CPUS are as in
bench.py. With BENCH_HOT=1 a third of the rounds, of the acquisitions, of the offices and of
the relationships belong to one company or person, and a third of the rounds to keys that
are no company. Tables and results are kept in a new folder below the session's shared one.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, functions as F

from dealscope.operators import explore
from dealscope.operators.cleaning import company_features
from dealscope.operators.split import stratified_folds, stratified_split
from dealscope.schemas import SOURCE_COLUMNS
from dealscope.session import local_session, scratch_path
from dealscope.sources.sample import sample_tables
from dealscope.sources.tables import SourceTables, land_parquet

KEYS = ("id", "parent_id", "object_id", "acquired_object_id", "acquiring_object_id", "person_object_id",
        "relationship_object_id")
SHIFT = 10_000_000_000
HOT_KEY = 7  # a company and a person of the sample

HOT_COLUMN = {"funding_rounds": "object_id", "acquisitions": "acquired_object_id", "offices": "object_id",
              "relationships": "person_object_id"}


def multiplied(df: DataFrame, copies: int, files: int) -> DataFrame:
    shifted = df.repartition(files).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for key in KEYS:
        if key in df.columns:
            shifted = shifted.withColumn(key, F.col(key) + F.col("_copy") * F.lit(SHIFT))
    return shifted.drop("_copy")


def heated(name: str, df: DataFrame) -> DataFrame:
    if name not in HOT_COLUMN:
        return df
    lane = F.pmod(F.xxhash64(*df.columns), F.lit(3))
    key = F.when(lane == 0, F.lit(HOT_KEY).cast("bigint"))
    if name == "funding_rounds":
        key = key.when(lane == 1, -F.col("object_id"))
    return df.withColumn(HOT_COLUMN[name], key.otherwise(F.col(HOT_COLUMN[name])))


def timed(seconds: dict, name: str, action):
    start = time.perf_counter()
    result = action()
    seconds[name] = round(time.perf_counter() - start, 2)
    return result


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies, hot = int(os.environ.get("BENCH_COPIES", "100")), os.environ.get("BENCH_HOT") == "1"
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "dealscope-scale", **{"spark.sql.shuffle.partitions": str(cpus * 4)})
    source = sample_tables(spark, folder)
    tables = SourceTables(**{
        name: multiplied(getattr(source, name), copies, cpus * 4) for name in SOURCE_COLUMNS})
    if hot:
        tables = SourceTables(**{name: heated(name, getattr(tables, name)) for name in SOURCE_COLUMNS})
    seconds: dict[str, float] = {}
    landed = timed(seconds, "land", lambda: land_parquet(tables, scratch_path(spark, "scale-tables")))
    path = scratch_path(spark, "scale-features")
    timed(seconds, "features", lambda: company_features(landed).write.parquet(path))
    features = spark.read.parquet(path)
    rows = features.count()

    def write(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed(seconds, "split", lambda: write(stratified_split(features)))
    timed(seconds, "folds", lambda: write(stratified_folds(features)))
    timed(seconds, "correlations", lambda: write(explore.correlations(features)))
    timed(seconds, "histograms", lambda: write(explore.histograms(features)))
    timed(seconds, "age_rates", lambda: write(explore.age_rates(features)))
    print(json.dumps({"copies": copies, "hot": hot, "rows": {
        **{name: getattr(landed, name).count() for name in SOURCE_COLUMNS}, "features": rows}, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
