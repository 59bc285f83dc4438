"""Column expressions. All of them are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dealscope.schemas import DEGREES, OTHER

# Fixed values the results depend on.
LISTED_COUNTRIES = ("USA", "NZL")
LISTED_STATE, LISTED_STATE_NAME = "CA", "California"
DEFAULT_AS_OF = "2014-01-01"
DAYS_PER_AGE_BUCKET = 365 * 5

MICROS_PER_DAY = 24 * 60 * 60 * 1_000_000


def degree_bucket(degree: Column, listed=DEGREES) -> Column:
    """Listed degree in lower case, else ``other``; NULL is ``other`` too."""
    lowered = F.lower(degree)
    return F.when(lowered.isin(*listed), lowered).otherwise(F.lit(OTHER))


def country_bucket(country: Column) -> Column:
    return F.when(country.isin(*LISTED_COUNTRIES), country).otherwise(F.lit(OTHER))


def state_bucket(state: Column) -> Column:
    return F.when(state == LISTED_STATE, F.lit(LISTED_STATE_NAME)).otherwise(F.lit(OTHER))


def age_bucket(age: Column) -> Column:
    """Whole five-year spans, rounded down (also below zero)."""
    return F.floor(age / F.lit(DAYS_PER_AGE_BUCKET)).cast("bigint")


def whole_days(df: DataFrame, end: str, start: str) -> Column:
    """Whole days from ``start`` to ``end``, rounded down.

    DATE columns differ by calendar days. Timestamps differ by elapsed time: 23:00 to 01:00
    is no whole day although a midnight lies between.
    """
    kinds = {type(df.schema[name].dataType) for name in (end, start)}
    if kinds == {T.DateType}:
        return F.datediff(end, start)
    micros = [F.unix_micros(F.col(name).cast("timestamp")) for name in (end, start)]
    return F.floor((micros[0] - micros[1]) / F.lit(MICROS_PER_DAY)).cast("int")


def no_nan(number: Column) -> Column:
    """NaN to NULL: NULL is the only missing value past the sources."""
    return F.nanvl(number, F.lit(None).cast("double"))


def parse_date(text: Column) -> Column:
    """Date from text, NULL where the text is no date."""
    return F.try_to_date(text)
