"""Company attributes joined with rounds, acquisitions, offerings, products and offices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dealscope.operators.copies import events_by_day, unroll
from dealscope.schemas import BASE_COLUMNS, COMPANY_COLUMNS
from dealscope.sources.tables import SourceTables


def _is_kind(kind: str, ignore_case: bool) -> Column:
    entity = F.col("entity_type")
    return (F.collate(entity, "UTF8_LCASE") if ignore_case else entity) == F.lit(kind)


def companies(objects: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Objects of kind Company. ``ignore_case`` compares like a case-insensitive collation."""
    return (objects.filter(_is_kind("Company", ignore_case))
            .select(F.col("id").alias("company_id"), *COMPANY_COLUMNS[1:]))


def round_stats(rounds: DataFrame) -> DataFrame:
    """Per company: mean money and participants over known values, and the number of rounds."""
    return rounds.groupBy(F.col("object_id").alias("round_company_id")).agg(
        F.avg("raised_amount_usd").cast("double").alias("average_funded"),
        F.count("*").alias("total_rounds"),
        F.avg("participants").cast("double").alias("average_participants"))


def product_counts(objects: DataFrame, ignore_case: bool = False) -> DataFrame:
    return (objects.filter(F.col("parent_id").isNotNull() & _is_kind("Product", ignore_case))
            .groupBy("parent_id").agg(F.count("*").alias("products_number")))


def office_counts(offices: DataFrame) -> DataFrame:
    return (offices.groupBy(F.col("object_id").alias("office_company_id"))
            .agg(F.count("*").alias("offices")))


def acquirer_counts(acquisitions: DataFrame) -> DataFrame:
    return (acquisitions.groupBy("acquiring_object_id")
            .agg(F.count("*").alias("acquired_companies")))


def join_rounds(company: DataFrame, stats: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Right outer join: every funded key stays, with NULL attributes where it is no company."""
    how = "right" if keep_unmatched else "inner"
    return company.join(stats, F.col("company_id") == F.col("round_company_id"), how)


def _acquisition_days(acquisitions: DataFrame) -> DataFrame:
    return events_by_day(acquisitions, "acquired_object_id", "acquired_at", "company_id", "_acquisitions")


def _ipo_days(ipos: DataFrame) -> DataFrame:
    return events_by_day(ipos, "object_id", "public_at", "company_id", "_ipos")


def _copies(*names: str) -> Column:
    """Product of the counts; an unmatched side counts once."""
    product = F.lit(1).cast("bigint")
    for name in names:
        product = product * F.coalesce(F.col(name), F.lit(1))
    return product


def join_acquisitions(company: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Left join with the times a company was acquired: one row per acquisition."""
    joined = company.join(_acquisition_days(acquisitions), "company_id", "left")
    return (unroll(joined, _copies("_acquisitions"), ("company_id", "acquired_at"))
            .drop("_acquisitions"))


def join_ipos(company: DataFrame, ipos: DataFrame) -> DataFrame:
    """Left join with the times a company went public: one row per offering."""
    joined = company.join(_ipo_days(ipos), "company_id", "left")
    return unroll(joined, _copies("_ipos"), ("company_id", "public_at")).drop("_ipos")


def join_products(company: DataFrame, counts: DataFrame) -> DataFrame:
    return company.join(counts.withColumnRenamed("parent_id", "company_id"), "company_id", "left")


def join_offices(company: DataFrame, counts: DataFrame) -> DataFrame:
    return company.join(counts.withColumnRenamed("office_company_id", "company_id"), "company_id", "left")


def join_acquirers(company: DataFrame, counts: DataFrame) -> DataFrame:
    return company.join(counts.withColumnRenamed("acquiring_object_id", "company_id"),
                        "company_id", "left")


def compact_base(tables: SourceTables, degrees: DataFrame | None = None, keep_unmatched: bool = True,
                 ignore_case: bool = False) -> DataFrame:
    """The base table with equal rows still counted in ``_acquisitions`` and ``_ipos``.

    All left joins come before the right join with rounds. Their keys are then never NULL
    and share one partitioning on company_id; joining rounds first would leave rows without
    a company, which later joins would send to a single task. ``degrees`` optionally adds
    per-company degree counts in the same partitioning.
    """
    company = companies(tables.objects, ignore_case)
    company = company.join(_acquisition_days(tables.acquisitions), "company_id", "left")
    company = company.join(_ipo_days(tables.ipos), "company_id", "left")
    company = join_products(company, product_counts(tables.objects, ignore_case))
    company = join_offices(company, office_counts(tables.offices))
    company = join_acquirers(company, acquirer_counts(tables.acquisitions))
    if degrees is not None:
        company = company.join(degrees, "company_id", "left")
    return join_rounds(company, round_stats(tables.funding_rounds), keep_unmatched)


def unroll_base(compact: DataFrame, spread: bool = True) -> DataFrame:
    by = ("round_company_id", "acquired_at", "public_at") if spread else ()
    return (unroll(compact, _copies("_acquisitions", "_ipos"), by)
            .drop("_acquisitions", "_ipos", "round_company_id"))


def company_base(tables: SourceTables, keep_unmatched: bool = True, ignore_case: bool = False,
                 spread: bool = True) -> DataFrame:
    """One row per funded key, acquisition and offering, with the 16 base columns."""
    compact = compact_base(tables, None, keep_unmatched, ignore_case)
    return unroll_base(compact, spread).select(*BASE_COLUMNS)
