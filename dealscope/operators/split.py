"""Stratified parts with exact sizes: hold-out split and cross-validation folds.

Rows are ordered by a hash of their content and cut at exact ranks per label. A window over
a two-valued label would put the table into two tasks, so the cut points are found by
counting hash prefixes: each pass narrows a cut to one prefix, and only rows sharing that
last prefix are ranked. Equal rows share one hash; where a cut falls among them they are
counted, divided and unrolled, so a row repeated very often is no single task's work either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dealscope.operators.copies import unroll
from dealscope.schemas import LABEL
from dealscope.session import stage

DIGITS_PER_PASS = 3
CELLS_PER_PASS = 16 ** DIGITS_PER_PASS
HASH_DIGITS = 32
RANKED_ROWS = 50_000
DECIMALS_IN_KEY = 6

Quotas = dict[object, list[int]]


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Text of a row's values. Doubles are rounded: the order in which a mean was summed up
    must not decide on which side of a cut a row falls."""
    parts = []
    for name in columns or df.columns:
        value = F.col(name)
        text = value.cast("string")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            text = F.coalesce(value.try_cast(f"decimal(38,{DECIMALS_IN_KEY})").cast("string"), text)
        parts.append(F.coalesce(text, F.lit("~")))
    return F.concat_ws("|", *parts)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), row_key(df, columns)))


def holdout_quotas(counts: dict[object, int], test_size: float = 0.2) -> Quotas:
    """[test, train] rows per label: the test part is rounded up over the whole table and the
    train rows are shared out by largest remainder."""
    total = sum(counts.values())
    train_total = total - math.ceil(test_size * total)
    exact = {label: train_total * n / total for label, n in counts.items()}
    train = {label: math.floor(share) for label, share in exact.items()}
    by_remainder = sorted(counts, key=lambda label: (train[label] - exact[label], str(label)))
    for label in by_remainder[:train_total - sum(train.values())]:
        train[label] += 1
    return {label: [n - train[label], train[label]] for label, n in counts.items()}


def fold_quotas(counts: dict[object, int], folds: int = 3) -> Quotas:
    """Rows per label and fold, the first folds taking the remainder."""
    return {label: [n // folds + (fold < n % folds) for fold in range(folds)]
            for label, n in counts.items()}


@dataclass(frozen=True)
class _Cell:
    """Hash prefix shared by the rows around a cut, and how many rows of the label precede it."""
    label: object
    prefix: str
    before: int


def quota_split(df: DataFrame, quotas_for: Callable[[dict[object, int]], Quotas], parts: Sequence,
                out: str, label: str = LABEL, columns: Sequence[str] | None = None,
                seed: int = 0) -> DataFrame:
    """Add column ``out`` naming each row's part.

    ``quotas_for`` turns the label counts into row counts per label and part. Rows are stored
    once with their hash; the counting passes then read nothing but label and hash.
    """
    if not isinstance(df.schema[label].dataType, T.BooleanType):
        raise ValueError(f"label {label} must be boolean")
    hashed = stage(df.withColumn("_hash", row_hash(df, columns, seed)), "hashed")
    first = _histogram(hashed, label)
    counts: dict[object, int] = {}
    for row in first:
        counts[row["_label"]] = counts.get(row["_label"], 0) + row["n"]
    quotas = quotas_for(counts)

    thresholds: dict[object, list[str]] = {}
    cells: set[_Cell] = set()
    for value, sizes in quotas.items():
        rank, thresholds[value] = 0, []
        for size in sizes[:-1]:
            rank += size
            cut, cell = _locate(hashed, label, value, rank, first)
            thresholds[value].append(cut)
            if cell:
                cells.add(cell)

    names = F.array(*[F.lit(part) for part in parts])

    def is_label(value: object) -> Column:
        return F.col(label).eqNullSafe(F.lit(value))

    at = F.lit(None).cast("int")
    for value, cuts in thresholds.items():
        passed = reduce(lambda a, b: a + b, [(F.col("_hash") >= cut).cast("int") for cut in cuts], F.lit(0))
        at = F.when(is_label(value), passed).otherwise(at)
    if not cells:
        return hashed.withColumn(out, names[at]).drop("_hash")

    in_cell = reduce(lambda a, b: a | b,
                     [is_label(c.label) & F.col("_hash").startswith(c.prefix) for c in cells])
    clear = hashed.filter(~in_cell).withColumn(out, names[at]).drop("_hash")
    before = F.lit(None).cast("bigint")
    for cell in cells:
        before = F.when(is_label(cell.label) & F.col("_hash").startswith(cell.prefix),
                        F.lit(cell.before)).otherwise(before)
    near = hashed.filter(in_cell).withColumn("_before", before)
    return clear.unionByName(_divide(near, df.columns, label, quotas, names, out))


def _histogram(hashed: DataFrame, label: str, prefix: str = "") -> list:
    """Rows per label and next hash digits: at most ``CELLS_PER_PASS`` rows for true, false and NULL each."""
    end = len(prefix) + DIGITS_PER_PASS
    rows = (hashed.filter(F.col("_hash").startswith(prefix)).groupBy(
        F.col(label).alias("_label"), F.substring("_hash", 1, end).alias("prefix"))
        .agg(F.count("*").alias("n"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))
        .collect())
    return sorted(rows, key=lambda row: row["prefix"])


def _locate(hashed: DataFrame, label: str, value: object, rank: int, level: list):
    """The hash that starts the rows after ``rank``, and the cell to divide if the cut is inside one."""
    before = 0
    while True:
        for row in (r for r in level if r["_label"] == value):
            if before == rank:
                return row["prefix"], None
            if before + row["n"] > rank:
                break
            before += row["n"]
        else:
            return "g", None  # above every hex digit: all rows precede the cut
        small = row["n"] <= RANKED_ROWS or row["low"] == row["high"]
        if small or len(row["prefix"]) >= HASH_DIGITS:
            return row["prefix"], _Cell(value, row["prefix"], before)
        chosen = hashed.filter(F.col(label).eqNullSafe(F.lit(value)))
        level = _histogram(chosen, label, row["prefix"])


def _divide(near: DataFrame, columns: Sequence[str], label: str, quotas: Quotas, names: Column,
            out: str) -> DataFrame:
    """Rank the distinct rows of each cell and give every part its share of their copies."""
    distinct = near.groupBy(*columns, "_hash", "_before").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(label, "_before").orderBy("_hash", *columns)
    ranked = distinct.withColumn("_end", F.col("_before") + F.sum("_n").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    shares = F.lit(None).cast("array<struct<part:int,low:bigint,high:bigint>>")
    for value, sizes in quotas.items():
        spans, low = [], 0
        for part, size in enumerate(sizes):
            spans.append(F.struct(F.lit(part).alias("part"), F.lit(low).cast("bigint").alias("low"),
                                  F.lit(low + size).cast("bigint").alias("high")))
            low += size
        shares = F.when(F.col(label).eqNullSafe(F.lit(value)), F.array(*spans)).otherwise(shares)
    shared = ranked.withColumn("_span", F.explode(shares))
    start = F.col("_end") - F.col("_n")
    copies = F.least("_end", "_span.high") - F.greatest(start, F.col("_span.low"))
    kept = shared.withColumn("_take", copies).filter(F.col("_take") > 0).withColumn(
        out, names[F.col("_span.part")])
    return unroll(kept, F.col("_take"), ("_hash", out)).select(*columns, out)


def stratified_split(df: DataFrame, test_size: float = 0.2, label: str = LABEL,
                     columns: Sequence[str] | None = None, seed: int = 0, out: str = "split") -> DataFrame:
    """Add ``split`` = test or train, stratified by the label."""
    return quota_split(df, lambda counts: holdout_quotas(counts, test_size), ["test", "train"], out,
                       label, columns, seed)


def stratified_folds(df: DataFrame, folds: int = 3, label: str = LABEL,
                     columns: Sequence[str] | None = None, seed: int = 0, out: str = "fold") -> DataFrame:
    """Add an int ``fold`` from 0, stratified by the label."""
    return quota_split(df, lambda counts: fold_quotas(counts, folds), list(range(folds)), out,
                       label, columns, seed)


def train_columns(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Label moved to the end; it stays in its row, so nothing has to be re-attached."""
    return df.select(*[c for c in df.columns if c != label], label)


def train_matrix(df: DataFrame, key: str = "company_id", label: str = LABEL) -> DataFrame:
    """Predictors without the key, label last."""
    return train_columns(df.drop(key), label)
