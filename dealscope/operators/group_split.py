"""Hold-out split that keeps all rows of a company on one side.

Companies are counted by signature, their numbers of positive and other rows. Signatures are taken from the largest to the
smallest, and each gives the test part as many of its companies as bring both labels closest to their share of
the rows seen so far; what one signature is off, the next ones make up for, down to companies of one row. Where there are
enough of these, each label ends within one row of its share; a company that holds much of the table leaves a lack that smaller
ones with both labels fill only in part. Which companies of a signature go is decided by their hash: cells of hash prefixes
are counted, and only the companies of the cell in which the cut falls are ranked.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window, functions as F

from dealscope.operators.split import stratified_split
from dealscope.schemas import LABEL
from dealscope.session import stage

PREFIX_DIGITS = 4


def test_companies(signatures: list[tuple[int, int, int]], share: float) -> dict[tuple[int, int], int]:
    """How many companies of each signature (positive rows, other rows, companies) are for testing.

    The share of a signature is the least-squares answer to what both labels lack, rounded.
    """
    chosen, lack_yes, lack_no = {}, 0.0, 0.0
    for yes, no, companies in sorted(signatures, key=lambda s: (-s[0] - s[1], -s[0])):
        lack_yes, lack_no = lack_yes + share * yes * companies, lack_no + share * no * companies
        wanted = floor((lack_yes * yes + lack_no * no) / (yes * yes + no * no) + 0.5)
        take = min(companies, max(0, wanted))
        chosen[yes, no] = take
        lack_yes, lack_no = lack_yes - take * yes, lack_no - take * no
    return chosen


def company_split(df: DataFrame, key: str = "company_id", test_size: float = 0.2, label: str = LABEL, seed: int = 0,
                  out: str = "split") -> DataFrame:
    """Add ``split`` = test or train, the same for all rows of a company. Rows without a company are dealt one by one.

    The signatures reach the driver: distinct pairs of counts, of which a table of n rows has in the order of n^(2/3) at most.
    """
    spark = df.sparkSession
    rows = stage(df, "split-rows")
    yes = F.count_if(F.col(label))
    counted = stage(rows.where(F.col(key).isNotNull()).groupBy(key).agg(yes.alias("_yes"), (F.count("*") - yes).alias("_no"))
                    .withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))), "companies")
    signatures = [tuple(r) for r in counted.groupBy("_yes", "_no").agg(F.count("*")).collect()]
    take = spark.createDataFrame([(y, n, t) for (y, n), t in test_companies(signatures, test_size).items()], "_yes long, _no long, _take long")

    prefix = F.substring("_hash", 1, PREFIX_DIGITS)
    cells = counted.groupBy("_yes", "_no", prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_yes", "_no").orderBy("_prefix")) - F.col("_n")
    cells = stage(cells.withColumn("_before", before).join(take, ["_yes", "_no"]), "cells")
    cut = cells.where((F.col("_before") < F.col("_take")) & (F.col("_take") < F.col("_before") + F.col("_n")))
    # The prefix up to which companies go: one row per signature.
    ends = cells.where(F.col("_before") + F.col("_n") <= F.col("_take")).groupBy("_yes", "_no").agg(F.max("_prefix").alias("_end"))
    within = Window.partitionBy("_yes", "_no").orderBy("_hash", key)
    near = (counted.join(cut.select("_yes", "_no", "_prefix", (F.col("_take") - F.col("_before")).alias("_left")),
                         (counted["_yes"] == cut["_yes"]) & (counted["_no"] == cut["_no"]) & (prefix == F.col("_prefix")))
            .select(counted["*"], "_left").withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= F.col("_left")))
    clear = counted.join(ends, ["_yes", "_no"]).where(prefix <= F.col("_end"))
    test = near.select(key).unionByName(clear.select(key)).withColumn("_test", F.lit(True))
    known = rows.where(F.col(key).isNotNull()).join(test, key, "left").withColumn(
        out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, out)
    alone = stratified_split(rows.where(F.col(key).isNull()), test_size, label, seed=seed, out=out)
    return known.unionByName(alone.select(*df.columns, out))
