"""Hand-made cases for the rules on missing values, dates, buckets and flags."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealscope.functions import scalars
from dealscope.operators import cleaning, company, degrees, explore, metrics
from dealscope.schemas import BASE_COLUMNS

DAY = dt.date(2010, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_missing_company_gets_the_counts_of_missing_company(spark):
    data = spark.createDataFrame([(1, 10.0), (None, 20.0), (3, 30.0)], "company_id long, average_funded double")
    wide = spark.createDataFrame([(None, 7, None, None, None), (1, 8, None, 2, None)],
                                 "company_id long, mba_degree long, phd_degree long, ms_degree long, other_degree long")
    got = degrees.extract_degrees(data, wide).select("company_id", "mba_degree", "phd_degree", "ms_degree").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, 8, None, 2), (None, 7, None, None), (3, None, None, None)], key=repr)


def test_no_relationship_without_company(spark):
    data = spark.createDataFrame([(None,), (1,)], "company_id long")
    wide = spark.createDataFrame([(1, 8, 1, 1, 1)], "company_id long, mba_degree long, phd_degree long, "
                                 "ms_degree long, other_degree long")
    got = {r["company_id"]: r["mba_degree"] for r in degrees.extract_degrees(data, wide).collect()}
    assert got == {None: None, 1: 8}


def test_text_keys(spark):
    objects = spark.createDataFrame([("c:1", "Company", None, "web")], "id string, entity_type string, "
                                    "parent_id string, category_code string")
    for name in ("founded_at", "closed_at", "country_code", "state_code", "city", "region"):
        objects = objects.withColumn(name, F.lit(None).cast("string"))
    rounds = spark.createDataFrame([("c:1", 5.0, 1), ("f:9", 7.0, 2)],
                                   "object_id string, raised_amount_usd double, participants int")
    joined = company.join_rounds(company.companies(objects), company.round_stats(rounds))
    got = {r["round_company_id"]: r["company_id"] for r in joined.collect()}
    assert got == {"c:1": "c:1", "f:9": None}


def test_inner_join_is_an_option(spark, tables):
    inner = company.company_base(tables, keep_unmatched=False)
    assert inner.filter("company_id is null").count() == 0 and inner.count() == 2963 - 150


def test_entity_type_compares_by_case_unless_told(spark):
    objects = spark.createDataFrame([(1, "company"), (2, "Company")], "id long, entity_type string")
    for name in ("category_code", "founded_at", "closed_at", "country_code", "state_code", "city", "region"):
        objects = objects.withColumn(name, F.lit(None).cast("string"))
    assert [r[0] for r in company.companies(objects).select("company_id").collect()] == [2]
    assert company.companies(objects, ignore_case=True).count() == 2


def test_mean_skips_missing_but_count_does_not(spark):
    rounds = spark.createDataFrame([(1, None, 0), (1, 4.0, None), (1, 8.0, 3)],
                                   "object_id long, raised_amount_usd double, participants int")
    row = company.round_stats(rounds).first()
    assert (row["average_funded"], row["total_rounds"], row["average_participants"]) == (6.0, 3, 1.5)


def test_dates_after_acquisition_are_blanked(spark):
    rows = [(1, day(1), day(0)), (2, day(0), day(0)), (3, day(-1), day(0)), (4, None, day(0)), (5, day(9), None)]
    df = spark.createDataFrame(rows, "id int, public_at date, acquired_at date").withColumn(
        "closed_at", F.col("public_at"))
    got = {r["id"]: (r["public_at"], r["closed_at"]) for r in cleaning.fix_post_acquisition(df).collect()}
    assert got == {1: (None, None), 2: (day(0),) * 2, 3: (day(-1),) * 2, 4: (None, None), 5: (day(9),) * 2}


def test_timestamps_count_elapsed_days(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2010, 1, 2, 1), dt.datetime(2010, 1, 1, 23)),
         (2, dt.datetime(2010, 1, 2, 23), dt.datetime(2010, 1, 1, 23)),
         (3, dt.datetime(2010, 1, 1, 11), dt.datetime(2010, 1, 1, 23))], "id int, a timestamp, b timestamp")
    got = df.select("id", scalars.whole_days(df, "a", "b").alias("d")).collect()
    assert {r["id"]: r["d"] for r in got} == {1: 0, 2: 1, 3: -1}


def test_flags_read_repaired_dates_and_undated_acquisitions_do_not_count(spark):
    df = spark.createDataFrame([(1, day(5), day(0), None), (2, day(0), None, day(3))],
                               "company_id int, public_at date, acquired_at date, closed_at date")
    got = {r["company_id"]: (r["ipo"], r["is_acquired"], r["is_closed"]) for r in
           df.transform(cleaning.fix_post_acquisition).transform(cleaning.binary_flags).collect()}
    assert got == {1: (False, True, False), 2: (True, False, True)}


def test_age(spark):
    rows = [(1, day(0), day(-1)), (2, day(0), day(0)), (3, day(0), day(5)), (4, None, day(5)),
            (5, dt.date(2013, 12, 31), None)]
    df = spark.createDataFrame(rows, "id int, founded_at date, acquired_at date")
    assert {r["id"]: r["age"] for r in cleaning.company_age(df).collect()} == {2: 0, 3: 5, 4: None, 5: 1}
    kept = cleaning.company_age(df, as_of="2014-01-03", drop_negative=False)
    assert {r["id"]: r["age"] for r in kept.collect()} == {1: -1, 2: 0, 3: 5, 4: None, 5: 3}
    assert {r["id"] for r in explore.known_age(kept).collect()} == {2, 3, 5}


def test_geo(spark):
    df = spark.createDataFrame([(None, None), ("USA", "CA"), ("NZL", "ca"), ("usa", "NY"), ("GBR", "CA")],
                               "country_code string, state_code string")
    assert [tuple(r) for r in cleaning.geo_buckets(df).collect()] == [
        ("other", "other"), ("USA", "California"), ("NZL", "other"), ("other", "other"), ("other", "California")]


def test_degree_buckets(spark):
    df = spark.createDataFrame([("MBA",), ("mba",), ("PhD",), ("BS",), (None,)], "degree_type string")
    assert [r[0] for r in df.select(scalars.degree_bucket(F.col("degree_type"))).collect()] == [
        "mba", "mba", "phd", "other", "other"]


def test_pairs_are_counted_people_on_request(spark):
    related = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, None)],
                                    "person_object_id long, relationship_object_id long")
    held = spark.createDataFrame([(1, "MBA"), (1, "mba"), (2, "x"), (3, "PhD"), (4, "ms")],
                                 "object_id long, degree_type string")
    def counts(**options):
        return {(r["company_id"], r["degree_type"]): r["count"]
                for r in degrees.degree_counts(related, held, **options).collect()}
    assert counts() == {(7, "mba"): 4, (7, "other"): 1, (None, "phd"): 1}
    assert counts(distinct_people=True) == {(7, "mba"): 1, (7, "other"): 1, (None, "phd"): 1}
    pivot = degrees.degree_pivot(degrees.degree_counts(related, held)).collect()
    assert {r["company_id"]: r["mba_degree"] for r in pivot} == {7: 4, None: None}


def test_other_degrees_may_be_listed(spark):
    related = spark.createDataFrame([(1, 7)], "person_object_id long, relationship_object_id long")
    held = spark.createDataFrame([(1, "BS")], "object_id long, degree_type string")
    assert degrees.degree_counts(related, held, listed=("bs",)).first()["degree_type"] == "bs"


def test_features_with_other_degrees(tables):
    from dealscope.operators.cleaning import company_features
    columns = company_features(tables, degrees=("mba", "bs")).columns
    assert [c for c in columns if c.endswith("_degree")] == ["mba_degree", "bs_degree", "other_degree"]
    assert columns[-4:] == ["ipo", "is_acquired", "is_closed", "age"]


def test_base_columns(tables):
    assert tuple(company.company_base(tables).columns) == BASE_COLUMNS


def test_metrics_are_those_of_the_positive_class(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)],
                               "label double, prediction double")
    row = metrics.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.5, 0.5, 0.5)
    none = metrics.classification_metrics(df.withColumn("prediction", F.lit(0.0))).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in explore.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "b"] == pytest.approx(1.0) and got["b", "a"] == got["a", "b"]
    assert got["c", "c"] is None and got["a", "c"] is None


def test_resampled_interval_brackets_the_rate(features):
    for interval in ("normal", "bootstrap"):
        for row in explore.age_rates(features, interval=interval).collect():
            assert row["low"] <= row["rate"] <= row["high"]
    young = features.withColumn("age", F.lit(10))
    a, b = [explore.age_rates(young, interval=i).first() for i in ("normal", "bootstrap")]
    assert a["low"] == pytest.approx(b["low"], abs=0.01) and a["high"] == pytest.approx(b["high"], abs=0.01)


def test_histograms_cover_all_complete_cases(features):
    cases = explore.complete_cases(features).count()
    per_column = explore.histograms(features).groupBy("column_name").agg(F.sum("companies")).collect()
    assert {n for _, n in per_column} == {cases} and len(per_column) == 6
    per_pair = explore.pair_histograms(features).groupBy("column_a", "column_b").agg(F.sum("companies")).collect()
    assert {r[2] for r in per_pair} == {cases} and len(per_pair) == 15
