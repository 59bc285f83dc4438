"""How many people with which degree are related to a company."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dealscope.functions.scalars import degree_bucket
from dealscope.schemas import DEGREES, OTHER, degree_columns

#: A person with over a thousandth of the relationships, and over a thousand, counts as heavy.
HEAVY_PEOPLE = 1_000


def heavy_people(related: DataFrame, most: int = HEAVY_PEOPLE) -> DataFrame:
    """Persons with very many rows in ``related``, ``most`` of them at the most.

    Found by a sketch of frequent items that is merged over the partitions, so no row of ``related`` is moved for it. Its
    errors decide only which way a person's rows are joined.
    """
    top = related.filter(F.col("person_object_id").isNotNull()).agg(
        F.expr(f"approx_top_k(person_object_id, {most}, {10 * most})").alias("_top"), F.count("*").alias("_rows"))
    return (top.select("_rows", F.explode("_top").alias("_t"))
            .filter(F.col("_t.count") > F.greatest(F.col("_rows") / most, F.lit(most)))
            .select(F.col("_t.item").alias("person_object_id")))


def person_degrees(degrees: DataFrame, listed: Sequence[str] = DEGREES) -> DataFrame:
    """One row per person: how many degrees the person holds in each bucket."""
    bucket = degree_bucket(F.col("degree_type"), listed)
    return (degrees.filter(F.col("object_id").isNotNull())
            .groupBy(F.col("object_id").alias("person_object_id"))
            .agg(*[F.count_if(bucket == name).alias(f"{name}_degree") for name in (*listed, OTHER)]))


def degrees_by_company(relationships: DataFrame, degrees: DataFrame, listed: Sequence[str] = DEGREES,
                       distinct_people: bool = False) -> DataFrame:
    """Company with one count per bucket, NULL where the company has none of it.

    Counts person-degree pairs; with ``distinct_people`` each person counts once per bucket.
    People are reduced to one row each first, so the many-to-many join becomes many-to-one
    and its pairs are never written out. Relationships of heavy persons stay where they are:
    their degree rows, as many as there may be heavy persons, are broadcast to them.
    """
    names = degree_columns(listed)
    related = relationships.select("person_object_id", F.col("relationship_object_id").alias("company_id"))
    held = person_degrees(degrees, listed)
    if distinct_people:
        related = related.distinct()
        held = held.select("person_object_id", *[F.least(F.col(n), F.lit(1)).alias(n) for n in names])
    heavy = F.broadcast(heavy_people(related))
    in_place = related.join(F.broadcast(held.join(heavy, "person_object_id", "left_semi")), "person_object_id")
    others = related.join(heavy, "person_object_id", "left_anti").join(held, "person_object_id")
    pairs = in_place.unionByName(others)
    return pairs.groupBy("company_id").agg(
        *[F.nullif(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in names])


def degree_counts(relationships: DataFrame, degrees: DataFrame, listed: Sequence[str] = DEGREES,
                  distinct_people: bool = False) -> DataFrame:
    """The same counts with one row per company and bucket."""
    wide = degrees_by_company(relationships, degrees, listed, distinct_people)
    renamed = wide.select("company_id", *[F.col(f"{n}_degree").alias(n) for n in (*listed, OTHER)])
    return (renamed.unpivot("company_id", [*listed, OTHER], "degree_type", "count")
            .filter(F.col("count").isNotNull()).select("count", "company_id", "degree_type"))


def degree_pivot(counts: DataFrame, listed: Sequence[str] = DEGREES) -> DataFrame:
    """One column per bucket from (count, company_id, degree_type) rows."""
    pivoted = counts.groupBy("company_id").pivot("degree_type", [*listed, OTHER]).sum("count")
    return pivoted.select("company_id", *[F.col(n).alias(f"{n}_degree") for n in (*listed, OTHER)])


def fill_no_company(data: DataFrame, wide: DataFrame, listed: Sequence[str] = DEGREES) -> DataFrame:
    """Give rows without a company the counts of the relationships without a company.

    Those counts are a global aggregate, one row by construction, so they are broadcast. The
    flag they join on is computed, since a constant would turn the join into nested loops.
    """
    names = degree_columns(listed)
    spare = (wide.filter(F.col("company_id").isNull())
             .agg((F.count("*") >= 0).alias("_no_company"),
                  *[F.sum(name).alias(f"_{name}") for name in names]))
    joined = data.join(F.broadcast(spare), data["company_id"].isNull() == F.col("_no_company"), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.col(f"_{name}")) for name in names}).drop(
        "_no_company", *[f"_{name}" for name in names])


def extract_degrees(data: DataFrame, wide: DataFrame, listed: Sequence[str] = DEGREES) -> DataFrame:
    """Left join in which a missing company matches the group of missing companies.

    Rows of ``data`` without a company match nothing under ``=`` and go round the join, so that equal rows are no task of
    their own; their counts come from the one-row group.
    """
    known = wide.filter(F.col("company_id").isNotNull())
    matched = data.filter(F.col("company_id").isNotNull()).join(known, "company_id", "left")
    others = data.filter(F.col("company_id").isNull())
    return fill_no_company(matched.unionByName(others, allowMissingColumns=True), wide, listed)
