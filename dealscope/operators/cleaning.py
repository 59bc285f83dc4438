"""From the base table to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dealscope.functions.scalars import (DEFAULT_AS_OF, country_bucket, state_bucket, whole_days)
from dealscope.operators.company import compact_base, unroll_base
from dealscope.operators.degrees import degrees_by_company, fill_no_company
from dealscope.schemas import DEGREES, FEATURE_COLUMNS, LABEL
from dealscope.sources.tables import SourceTables


def fix_post_acquisition(df: DataFrame, columns: Sequence[str] = ("public_at", "closed_at")) -> DataFrame:
    """Blank the dates that lie a whole day or more after the acquisition."""
    return df.withColumns({
        name: F.when(whole_days(df, name, "acquired_at") > 0, F.lit(None)).otherwise(F.col(name))
        for name in columns})


def binary_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"ipo": F.col("public_at").isNotNull(),
                           LABEL: F.col("acquired_at").isNotNull(),
                           "is_closed": F.col("closed_at").isNotNull()})


def company_age(df: DataFrame, as_of: str = DEFAULT_AS_OF, drop_negative: bool = True) -> DataFrame:
    """Age in days at the acquisition, else at ``as_of``. Unknown ages stay, negative ones go."""
    until = F.coalesce(F.col("acquired_at"), F.lit(as_of).cast(df.schema["acquired_at"].dataType))
    dated = df.withColumn("_until", until)
    aged = dated.withColumn("age", whole_days(dated, "_until", "founded_at")).drop("_until")
    return aged.filter(F.col("age").isNull() | (F.col("age") >= 0)) if drop_negative else aged


def geo_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({"country_code": country_bucket(F.col("country_code")),
                           "state_code": state_bucket(F.col("state_code"))})


def clean(df: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """All cleaning steps in their fixed order: dates are repaired before flags read them."""
    return (df.transform(fix_post_acquisition).transform(binary_flags)
            .transform(company_age, as_of).transform(geo_buckets))


def company_features(tables: SourceTables, as_of: str = DEFAULT_AS_OF, degrees: Sequence[str] = DEGREES,
                     distinct_people: bool = False, keep_unmatched: bool = True,
                     ignore_case: bool = False, spread: bool = True) -> DataFrame:
    """The feature table: base, degree counts and cleaning as one plan.

    Cleaning works on counted rows, which are unrolled last. ``spread=False`` saves the
    exchange that balances unrolling, for data known to have few equal events per company.
    """
    wide = degrees_by_company(tables.relationships, tables.degrees, degrees, distinct_people)
    compact = compact_base(tables, wide, keep_unmatched, ignore_case)
    cleaned = clean(fill_no_company(compact, wide, degrees), as_of)
    names = [n for n in FEATURE_COLUMNS if not n.endswith("_degree")]
    at = names.index("ipo")
    order = names[:at] + [f"{d}_degree" for d in (*degrees, "other")] + names[at:]
    return unroll_base(cleaned, spread).select(*order)
