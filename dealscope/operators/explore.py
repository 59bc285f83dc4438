"""Profiles of the feature table: rates, counts, correlations, completeness, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dealscope.functions.scalars import age_bucket
from dealscope.operators.copies import CHUNK
from dealscope.operators.split import row_key
from dealscope.schemas import ECONOMIC_COLUMNS, LABEL, NUMERIC_GAP_COLUMNS

Z_95 = 1.96
BINS = 10
# Share of a sum of squares below which its spread is rounding error.
ROUNDING = 1e-12


def _rate(label: str = LABEL) -> Column:
    return F.avg(F.col(label).cast("double"))


def profile(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows, columns and the share of positive labels, as one row."""
    return df.agg(F.count("*").alias("total_companies"),
                  F.lit(len(df.columns)).alias("total_features"),
                  _rate(label).alias("acquired_share"))


def known_age(df: DataFrame) -> DataFrame:
    """Rows with an age of zero or more. Unlike in the feature job, unknown ages go too."""
    return df.filter(F.col("age") >= 0)


def complete_cases(df: DataFrame, columns: Sequence[str] = (*ECONOMIC_COLUMNS, LABEL)) -> DataFrame:
    return df.select(*columns).na.drop("any")


def age_counts(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("age").isNotNull())
            .groupBy(age_bucket(F.col("age")).alias("age_bucket"))
            .agg(F.count("*").alias("companies")))


def age_rates(df: DataFrame, label: str = LABEL, interval: str = "normal", seed: int = 0,
              resamples: int = 200) -> DataFrame:
    """Positive share per five-year age bucket with a 95 % interval.

    ``normal`` uses the normal approximation. ``bootstrap`` takes percentiles over resampled shares (``resampled_rates``).
    """
    aged = df.filter(F.col("age").isNotNull()).withColumn("age_bucket", age_bucket(F.col("age")))
    rates = aged.groupBy("age_bucket").agg(_rate(label).alias("rate"), F.count("*").alias("companies"))
    if interval == "bootstrap":
        return rates.join(resampled_rates(aged, "age_bucket", label, seed, resamples, row_key(df)), "age_bucket")
    half = F.lit(Z_95) * F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / F.col("companies"))
    return rates.select("age_bucket", "rate", "companies", (F.col("rate") - half).alias("low"),
                        (F.col("rate") + half).alias("high"))


# Numbers of 65,536 below which a uniform 16-bit number gives 0, 1, 2, ... for a Poisson variable of mean 1.
POISSON_STEPS = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)
DRAWS_PER_HASH = 8


def resampled_rates(df: DataFrame, by: str, label: str, seed: int, resamples: int, identity: Column) -> DataFrame:
    """``low`` and ``high`` per group: the 2.5th and 97.5th percentile (nearest rank) of shares over resamples.

    In a resample every row counts as often as a Poisson variable of mean 1 says, which is drawn from a hash of the row,
    the seed and the resample, so any split of the rows gives the same sums and they merge map-side: one hash
    serves eight resamples, whose sixteen sums are one row. Equal rows are counted and numbered, a repeated row in
    chunks of CHUNK copies that are spread over tasks. A resample without rows has no share.
    """
    turns = -(-resamples // DRAWS_PER_HASH)
    counted = df.groupBy(by, F.col(label).cast("int").alias("_positive"), identity.alias("_identity")).agg(F.count("*").alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(CHUNK)).cast("bigint"))))
    first = F.col("_chunk") * F.lit(CHUNK)
    copies = chunks.repartition("_identity", "_chunk").withColumn(
        "_copy", F.explode(F.sequence(first, F.least(F.col("_n"), first + F.lit(CHUNK)) - 1)))
    drawn = copies.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("_turn").cast("string"), F.lit("|"), F.col("_copy").cast("string"), F.lit("|"), F.col("_identity")))
    drawn = drawn.select(by, "_positive", "_turn", digest.alias("_digest"))

    def times(draw: int) -> Column:
        uniform = F.conv(F.substring("_digest", 4 * draw + 1, 4), 16, 10).cast("int")
        return sum(((uniform >= step).cast("int") for step in POISSON_STEPS), F.lit(0))

    sums = drawn.groupBy(by, "_turn").agg(
        *[of.alias(f"{name}{i}") for i in range(DRAWS_PER_HASH)
          for name, of in (("_all", F.sum(times(i))), ("_set", F.sum(times(i) * F.col("_positive"))))])
    shares = sums.select(by, F.inline(F.array(*[F.struct(
        (F.col("_turn") * DRAWS_PER_HASH + i).alias("_resample"),
        (F.col(f"_set{i}") / F.nullif(F.col(f"_all{i}"), F.lit(0))).alias("_share")) for i in range(DRAWS_PER_HASH)])))
    # At most ``resamples`` shares per group.
    listed = shares.where(F.col("_resample") < resamples).groupBy(by).agg(F.sort_array(F.collect_list("_share")).alias("_shares"))

    def percentile(share: float) -> Column:
        return F.get("_shares", (F.ceil(F.size("_shares") * F.lit(share)) - 1).cast("int"))

    return listed.select(by, percentile(0.025).alias("low"), percentile(0.975).alias("high"))


def category_rates(df: DataFrame, by: str = "category_code", label: str = LABEL) -> DataFrame:
    """Positive share and count per category, highest share first; no row for NULL."""
    return (df.filter(F.col(by).isNotNull()).groupBy(by)
            .agg(_rate(label).alias("rate"), F.count("*").alias("companies"))
            .orderBy(F.desc("rate"), by))


def correlations(df: DataFrame, columns: Sequence[str] = NUMERIC_GAP_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair over the rows that know both; NULL where a side is constant.

    Each row is repeated once per column and the sums of its pairs are grouped by that
    column. That keeps the number of sums per group small enough for generated code, which a
    single aggregate over all pairs is not. A first pass finds the means, to sum around them.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.select(*[(F.col(c) - F.lit(means[c])).alias(f"b{i}") for i, c in enumerate(columns)])
    sides = [f"b{i}" for i in range(len(columns))]
    paired = centred.unpivot(sides, sides, "side", "a").filter(F.col("a").isNotNull())
    sums = paired.groupBy("side").agg(*[F.expr(text).alias(f"{name}_{b}") for b in sides for name, text in (
        ("n", f"count({b})"), ("sb", f"sum({b})"), ("sbb", f"sum({b} * {b})"), ("sab", f"sum(a * {b})"),
        ("sa", f"sum(if({b} is null, null, a))"), ("saa", f"sum(if({b} is null, null, a * a))"))])
    rows = F.array(*[F.struct(F.lit(name).alias("column_b"), *[
        F.col(f"{part}_{b}").alias(part) for part in ("n", "sb", "sbb", "sab", "sa", "saa")])
        for b, name in zip(sides, columns)])
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("side", 2, 9).cast("int") + 1)
    cells = sums.select(named.alias("column_a"), F.inline(rows))

    def spread(total: str, squares: str) -> Column:
        rest = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
        return F.when(rest > F.col(squares) * F.lit(ROUNDING), F.sqrt(rest))

    shared = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    r = F.when(F.col("n") > 1, shared / (spread("sa", "saa") * spread("sb", "sbb")))
    return cells.select("column_a", "column_b", r.alias("r"))


def completeness(df: DataFrame) -> DataFrame:
    """Share of known values per column."""
    once = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    return once.unpivot([], list(once.columns), "column_name", "completeness")


def _binned(df: DataFrame, columns: Sequence[str], label: str, bins: int) -> DataFrame:
    """Complete cases reduced to counts per label and combination of equal-width bins.

    One job finds the limits, a single row. Everything after this works on combinations of
    bins instead of rows.
    """
    cases = complete_cases(df, (*columns, label))
    row = cases.agg(*[F.min(c).cast("double").alias(f"low_{c}") for c in columns],
                    *[F.max(c).cast("double").alias(f"high_{c}") for c in columns]).first()
    return cases.groupBy(label, *[
        _bin(F.col(c).cast("double"), row[f"low_{c}"], row[f"high_{c}"], bins).alias(c) for c in columns
    ]).agg(F.count("*").alias("_n"))


def _bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Bin 0 to ``bins`` - 1; the highest value falls in the last bin, a constant in the first."""
    if low is None or low == high:
        return F.lit(0).cast("bigint")
    at = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins))
    return F.least(at, F.lit(bins - 1).cast("bigint"))


def histograms(df: DataFrame, columns: Sequence[str] = ECONOMIC_COLUMNS, label: str = LABEL,
               bins: int = BINS) -> DataFrame:
    """Rows per label, column and bin: the diagonal of a pair plot."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("bin"))
                               for c in columns]))
    return (_binned(df, columns, label, bins).select(label, "_n", cells)
            .groupBy(label, "column_name", "bin").agg(F.sum("_n").alias("companies")))


def pair_histograms(df: DataFrame, columns: Sequence[str] = ECONOMIC_COLUMNS, label: str = LABEL,
                    bins: int = BINS) -> DataFrame:
    """Rows per label, pair of columns and pair of bins: the off-diagonal of a pair plot."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 F.col(a).alias("bin_a"), F.col(b).alias("bin_b"))
        for i, a in enumerate(columns) for b in columns[i + 1:]]))
    return (_binned(df, columns, label, bins).select(label, "_n", cells)
            .groupBy(label, "column_a", "column_b", "bin_a", "bin_b").agg(F.sum("_n").alias("companies")))
