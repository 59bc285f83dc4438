"""Row counts of the sample tables as recorded in FIXTURES.md section 3."""

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from dealscope.operators import company
from dealscope.operators.cleaning import company_age, company_features
from dealscope.operators.degrees import degree_counts
from dealscope.sources.sample import sample_tables

GOLDEN = {
    "sf0.001": dict(companies=135, rounds=1373, acquisitions=188, ipos=188, offices=1124, relationships=6000,
                    degrees=15, base=291, known=122, unmatched=15, unfunded=30, no_participants=24,
                    buyers=86, labels={False: 120, True: 115}, degree_rows=604),
    "sf0.01": dict(companies=1350, rounds=13701, acquisitions=1875, ipos=1875, offices=11250, relationships=60000,
                   degrees=150, base=2963, known=1225, unmatched=150, unfunded=271, no_participants=283,
                   buyers=706, labels={False: 1167, True: 1213}, degree_rows=5999),
}


@pytest.mark.parametrize("scale", sorted(GOLDEN))
def test_counts(spark, scale):
    tables, want = sample_tables(spark, f"{TESTDATA}/{scale}"), GOLDEN[scale]
    assert company.companies(tables.objects).count() == want["companies"]
    assert tables.funding_rounds.count() == want["rounds"]
    for name in ("acquisitions", "ipos", "offices", "relationships", "degrees"):
        assert getattr(tables, name).count() == want[name]
    row = company.company_base(tables).agg(
        F.count("*").alias("base"), F.countDistinct("company_id").alias("known"),
        F.count_if(F.isnull("company_id")).alias("unmatched"),
        F.count_if(F.isnull("average_funded")).alias("unfunded"),
        F.count_if(F.col("average_participants") == 0).alias("no_participants"),
        F.count_if(F.col("acquired_companies") > 1).alias("buyers")).first().asDict()
    assert row == {name: want[name] for name in row}
    labels = company_features(tables).groupBy("is_acquired").count().collect()
    assert {r["is_acquired"]: r["count"] for r in labels} == want["labels"]
    assert degree_counts(tables.relationships, tables.degrees).count() == want["degree_rows"]


def test_ages(tables):
    aged = company_age(company.company_base(tables), drop_negative=False)
    row = aged.agg(F.count_if(F.col("age") < 0), F.count_if(F.isnull("age"))).first()
    assert tuple(row) == (583, 287)


@pytest.mark.parametrize("scale", sorted(GOLDEN))
def test_every_raw_row_has_a_role(spark, scale):
    raw = {name: spark.read.parquet(f"{TESTDATA}/{scale}/{name}.parquet").count() for name in
           ("customer", "part", "orders", "lineitem", "supplier")}
    tables = sample_tables(spark, f"{TESTDATA}/{scale}")
    assert tables.objects.count() == raw["customer"] + raw["part"]
    assert tables.acquisitions.count() + tables.ipos.count() + tables.offices.count() == raw["orders"]
    assert tables.relationships.count() == raw["lineitem"]
    assert tables.degrees.select("object_id").distinct().count() == raw["supplier"]
