"""Rows that stand for many equal rows, and turning them back into single rows.

A company may own a very large number of acquisition or offering rows. Equal ones are
counted before the shuffle and travel as one row with a number of copies, so a hot company
costs its joins one row per distinct day. ``unroll`` restores every copy at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 1_000


def events_by_day(events: DataFrame, key: str, day: str, key_as: str, copies: str) -> DataFrame:
    """Distinct (key, day) pairs with how often each occurs; combined before the shuffle."""
    return (events.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(key_as), F.col(day).alias(day))
            .agg(F.count("*").alias(copies)))


def unroll(df: DataFrame, copies: Column, spread_by: Sequence[str] = ()) -> DataFrame:
    """Repeat each row ``copies`` times.

    Rows are first cut into chunks of at most ``CHUNK`` copies and the chunks are spread over
    tasks by ``spread_by``, so no task has to emit a hot row's copies alone. Chunks are small
    because partitions may be merged at run time by their size before unrolling. Without
    ``spread_by`` rows are repeated where they are.
    """
    if not spread_by:
        return (df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy"))
    whole = (df.withColumn("_copies", copies)
             .withColumn("_chunk", F.explode(F.sequence(
                 F.lit(0), F.floor((F.col("_copies") - 1) / F.lit(CHUNK)).cast("bigint"))))
             .repartition(*spread_by, "_chunk"))
    left = F.col("_copies") - F.col("_chunk") * F.lit(CHUNK)
    return (whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(left, F.lit(CHUNK)))))
            .drop("_copies", "_chunk", "_copy"))
