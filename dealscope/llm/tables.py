"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key with more than this share of the rows counts as hot; so at most ``HOT_PARTS`` keys are hot.
HOT_PARTS = 1000

#: Bits of a filter for each of its keys, and the most words of 64 bits it may have: some 64 MB.
FILTER_BITS = 32
FILTER_WORDS = 1 << 22


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Left join with a unique right side whose column ``size`` counts the left rows of its key.

    Keys with more than 1/HOT_PARTS of the left rows are at most HOT_PARTS many; those rows of the right
    side are broadcast. All other keys are joined by a shuffle, where none is large.
    """
    limit = max(HOT_PARTS, total // HOT_PARTS)
    hot = right.where(F.col(size) > limit)
    fields = [name for name in right.columns if name not in keys]
    packed = F.broadcast(hot.select(*keys, F.struct(*fields).alias("_hot")))
    marked = left.join(packed, list(keys), "left")
    names = [name for name in left.columns]
    out = [marked[name] for name in names]
    in_place = marked.where(F.col("_hot").isNotNull()).select(*out, *[F.col("_hot")[f].alias(f) for f in fields])
    others = (marked.where(F.col("_hot").isNull()).select(*out)
              .join(right.where(F.col(size) <= limit), list(keys), "left").select(*names, *fields))
    return in_place.unionByName(others)


def maybe_among(rows: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose ``names`` are not in ``wanted``; none that is in it is lost.

    A Bloom filter of one hash: the bits that ``wanted`` sets are united over its partitions into words, and the words, no
    more than ``FILTER_WORDS`` of them, are broadcast to where the rows are read. So rows are sorted out before any
    shuffle. With more wanted rows than bits the filter passes most rows; an exact join follows in any case.
    """
    count, words = wanted.count(), 1
    while words * 64 < count * FILTER_BITS and words < FILTER_WORDS:
        words *= 2
    place = F.pmod(F.xxhash64(*names, F.lit("filter")), F.lit(words * 64)).cast("long")
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bits = (wanted.select(word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit"))
            .groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.col("_one"), F.col("_bit"))).alias("_bits")))
    # Each row is one column meanwhile, so that its columns may have any names.
    tested = (rows.select(F.struct(*rows.columns).alias("_row"), word.alias("_at"), bit.alias("_bit"))
              .join(F.broadcast(bits), F.col("_at") == F.col("_word"))
              .where(F.call_function("getbit", F.col("_bits"), F.col("_bit")) == 1))
    return tested.select(*[F.col("_row")[name].alias(name) for name in rows.columns])


def identity(key: str, content: Column) -> dict[str, Column]:
    """Columns that tell documents apart, none of them null: by key and content."""
    return {"_none": F.col(key).isNull(), "_key": F.coalesce(F.col(key).cast("long"), F.lit(0)), "_content": content}


def only(docs: DataFrame, stay: DataFrame, key: str, content: Column) -> DataFrame:
    """The rows of ``docs`` whose identity is in ``stay``; rows that repeat an identity stay once.

    One shuffle serves both the join and the removal of repeats. Each row of ``docs`` is one column meanwhile, so that
    its columns may have any names.
    """
    marks = identity(key, content)
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *[mark.alias(name) for name, mark in marks.items()])
    left = marked.join(stay.select(*marks), list(marks), "left_semi").dropDuplicates(list(marks))
    return left.select(*[F.col("_row")[name].alias(name) for name in docs.columns])
