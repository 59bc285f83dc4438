"""Every operator as a named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dealscope.operators import (calibration, cleaning, company, degrees, encoding, explore, fold_fit, group_split, imputers, metrics, preprocess, search,
                                 split)
from dealscope.operators.robust_line import fit_line
from dealscope.schemas import LABEL, SOURCE_COLUMNS
from dealscope.session import scratch_path, stage
from dealscope.sources.files import read_csv, read_part, write_csv, write_split
from dealscope.sources.sample import sample_tables

Query = Callable[[SparkSession, str], DataFrame]

CATALOGUE: dict[str, Query] = {}

# One point of the full grid per family, with its usual number of steps, for the queries that fit a single model. The search takes the full grid.
GRID_POINTS = (
    search.Candidate.of("gbt", trees=100, depth=5),
    search.Candidate.of("rbf_svm", cost=1, gamma=search.AUTO),
    search.Candidate.of("poly_svm", cost=1, gamma=search.AUTO, degree=3),
    search.Candidate.of("mlp", layers=(25,), activation="relu", alpha=0.1),
)


def query(function: Query) -> Query:
    CATALOGUE[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order in the last digits."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def with_known_digits(df: DataFrame, raw: str, filled: str, gap) -> DataFrame:
    """Rounded, means to six digits, where they have no ties, and values of a line to four."""
    value = F.when(gap, F.round(filled, 4)).otherwise(F.round(raw, 6))
    return rounded(df.withColumn(filled, value))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.company_features(sample_tables(spark, folder))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table written once, for operators that read it several times."""
    return stage(features(spark, folder), "features")


# Sources and sinks.

@query
def scan_sources(spark, folder):
    tables = sample_tables(spark, folder)
    counts = None
    for name, columns in SOURCE_COLUMNS.items():
        one = getattr(tables, name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("row_count"),
            F.count(columns[0]).alias("known_keys"), F.count(columns[-1]).alias("known_last"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    write_csv(features(spark, folder), path)
    return rounded(read_csv(spark, path))


@query
def csv_split(spark, folder):
    path = scratch_path(spark, "split-csv")
    write_split(split.train_columns(split.stratified_split(features(spark, folder))), path, format="csv")
    parts = [read_part(spark, path, part, format="csv").withColumn("split", F.lit(part)) for part in ("train", "test")]
    return rounded(parts[0].unionByName(parts[1]))


@query
def split_stratified(spark, folder):
    path = scratch_path(spark, "split")
    write_split(split.train_columns(split.stratified_split(features(spark, folder))), path)
    parts = [read_part(spark, path, part).withColumn("split", F.lit(part)) for part in ("train", "test")]
    return rounded(parts[0].unionByName(parts[1]))


# Joins and aggregates of the base table.

@query
def companies(spark, folder):
    return company.companies(sample_tables(spark, folder).objects)


@query
def round_stats(spark, folder):
    return rounded(company.round_stats(sample_tables(spark, folder).funding_rounds))


@query
def product_counts(spark, folder):
    return company.product_counts(sample_tables(spark, folder).objects)


@query
def office_counts(spark, folder):
    return company.office_counts(sample_tables(spark, folder).offices)


@query
def acquirer_counts(spark, folder):
    return company.acquirer_counts(sample_tables(spark, folder).acquisitions)


@query
def rounds_right_join(spark, folder):
    tables = sample_tables(spark, folder)
    return rounded(company.join_rounds(company.companies(tables.objects),
                                       company.round_stats(tables.funding_rounds)))


@query
def join_acquisitions(spark, folder):
    tables = sample_tables(spark, folder)
    return company.join_acquisitions(company.companies(tables.objects), tables.acquisitions)


@query
def join_ipos(spark, folder):
    tables = sample_tables(spark, folder)
    return company.join_ipos(company.companies(tables.objects), tables.ipos)


@query
def join_products(spark, folder):
    tables = sample_tables(spark, folder)
    return company.join_products(company.companies(tables.objects), company.product_counts(tables.objects))


@query
def join_offices(spark, folder):
    tables = sample_tables(spark, folder)
    return company.join_offices(company.companies(tables.objects), company.office_counts(tables.offices))


@query
def join_acquirers(spark, folder):
    tables = sample_tables(spark, folder)
    return company.join_acquirers(company.companies(tables.objects),
                                  company.acquirer_counts(tables.acquisitions))


@query
def company_base(spark, folder):
    return rounded(company.company_base(sample_tables(spark, folder)))


# Degrees.

@query
def degree_counts(spark, folder):
    tables = sample_tables(spark, folder)
    return degrees.degree_counts(tables.relationships, tables.degrees)


@query
def degree_people(spark, folder):
    tables = sample_tables(spark, folder)
    return degrees.degree_counts(tables.relationships, tables.degrees, distinct_people=True)


@query
def degree_pivot(spark, folder):
    return degrees.degree_pivot(degree_counts(spark, folder))


@query
def extract_degrees(spark, folder):
    tables = sample_tables(spark, folder)
    wide = degrees.degrees_by_company(tables.relationships, tables.degrees)
    return rounded(degrees.extract_degrees(company.company_base(tables), wide))


# Cleaning.

@query
def fix_post_acquisition(spark, folder):
    fixed = cleaning.fix_post_acquisition(company.company_base(sample_tables(spark, folder)))
    return fixed.select("company_id", "acquired_at", "public_at", "closed_at")


@query
def binary_flags(spark, folder):
    base = cleaning.fix_post_acquisition(company.company_base(sample_tables(spark, folder)))
    return cleaning.binary_flags(base).select("company_id", "ipo", "is_acquired", "is_closed")


@query
def company_age(spark, folder):
    aged = cleaning.company_age(company.company_base(sample_tables(spark, folder)))
    return aged.select("company_id", "founded_at", "acquired_at", "age")


@query
def geo_buckets(spark, folder):
    base = cleaning.geo_buckets(company.company_base(sample_tables(spark, folder)))
    return base.groupBy("country_code", "state_code").agg(F.count("*").alias("companies"))


@query
def company_features(spark, folder):
    return rounded(features(spark, folder))


@query
def train_matrix(spark, folder):
    return rounded(split.train_matrix(features(spark, folder)))


# Exploration.

@query
def eda_profile(spark, folder):
    return rounded(explore.profile(features(spark, folder)))


@query
def eda_age_filter(spark, folder):
    return explore.known_age(features(spark, folder)).select("company_id", "age", LABEL)


@query
def eda_age_rate(spark, folder):
    return rounded(explore.age_rates(features(spark, folder)))


@query
def eda_age_rate_resampled(spark, folder):
    return rounded(explore.age_rates(features(spark, folder), interval="bootstrap"))


@query
def eda_age_count(spark, folder):
    return explore.age_counts(features(spark, folder))


@query
def eda_known_age_rate(spark, folder):
    return rounded(explore.age_rates(explore.known_age(features(spark, folder))))


@query
def eda_known_age_count(spark, folder):
    return explore.age_counts(explore.known_age(features(spark, folder)))


@query
def eda_category_rate(spark, folder):
    return rounded(explore.category_rates(explore.known_age(features(spark, folder))))


@query
def eda_corr(spark, folder):
    return rounded(explore.correlations(explore.known_age(stored(spark, folder))), 8)


@query
def eda_completeness(spark, folder):
    return rounded(explore.completeness(explore.known_age(features(spark, folder))))


@query
def eda_complete_cases(spark, folder):
    return rounded(explore.complete_cases(explore.known_age(features(spark, folder))))


@query
def eda_histograms(spark, folder):
    return explore.histograms(explore.known_age(stored(spark, folder)))


@query
def eda_pair_histograms(spark, folder):
    return explore.pair_histograms(explore.known_age(stored(spark, folder)))


# Preprocessing.

@query
def impute_constant(spark, folder):
    table = features(spark, folder)
    for names, value in ((preprocess.ZERO_IF_MISSING, 0), (preprocess.ONE_IF_MISSING, 1)):
        table = imputers.ConstantImputer(inputCols=list(names), outputCols=list(names), value=value).transform(table)
    return table.select("company_id", *preprocess.ZERO_IF_MISSING, *preprocess.ONE_IF_MISSING)


@query
def impute_mean(spark, folder):
    ages = stage(features(spark, folder).select("company_id", F.col("age").cast("double").alias("age")))
    imputer = Imputer(strategy="mean", inputCols=["age"], outputCols=["age_filled"])
    return rounded(imputer.fit(ages).transform(ages))


@query
def impute_mode(spark, folder):
    table = stage(features(spark, folder).select("company_id", *preprocess.CATEGORIES))
    return preprocess.fill_categories().fit(table).transform(table)


@query
def one_hot(spark, folder):
    table = stage(features(spark, folder).select("company_id", *preprocess.CATEGORIES))
    known = preprocess.fill_categories().fit(table).transform(table)
    for binarizer in preprocess.fit_binarizers(table):
        known = binarizer.fit(known).transform(known)
    return preprocess.hot_text(known, ["company_id"])


@query
def funds_by_rounds(spark, folder):
    return rounded(imputers.funds_by_rounds(features(spark, folder)))


@query
def robust_line(spark, folder):
    table = stage(features(spark, folder).select("average_funded", "average_participants"))
    line = fit_line(table.filter(F.col("average_participants") != 0), "average_funded", "average_participants")
    return rounded(table.agg(
        F.lit(line.inliers).cast("bigint").alias("inliers"), F.lit(line.intercept).alias("at_zero"),
        line.at(F.lit(1e6)).alias("at_million"), F.count("*").alias("rows_read")), 4)


@query
def impute_funds(spark, folder):
    table = stage(features(spark, folder).select("company_id", "total_rounds", "average_funded"))
    filled = imputers.fund_imputer("funded_filled").fit(table).transform(table)
    return with_known_digits(filled, "average_funded", "funded_filled", F.col("average_funded").isNull())


@query
def impute_participants(spark, folder):
    table = stage(features(spark, folder).select("company_id", "average_funded", "average_participants"))
    imputer = imputers.participants_imputer("participants_filled")
    gap = (F.col("average_participants") == 0) & F.col("average_funded").isNotNull()
    return with_known_digits(imputer.fit(table).transform(table), "average_participants", "participants_filled", gap)


def prepared_features(spark: SparkSession, folder: str) -> DataFrame:
    table = stored(spark, folder)
    return preprocess.preprocessing(preprocess.fit_binarizers(table)).fit(table).transform(table)


@query
def standardize(spark, folder):
    scalars = preprocess.scalar_inputs(prepared_features(spark, folder), ["company_id"])
    return rounded(scalars.select("company_id", *preprocess.SCALED), 4)


@query
def feature_vector(spark, folder):
    slots = F.transform(vector_to_array("features"), lambda v: v.cast("decimal(18,3)").cast("string"))
    return prepared_features(spark, folder).select(
        "company_id", F.size(slots).cast("bigint").alias("width"), F.array_join(slots, " ").alias("slots"))


@query
def stratified_folds(spark, folder):
    return rounded(split.stratified_folds(features(spark, folder)))


@query
def split_by_company(spark, folder):
    return rounded(group_split.company_split(features(spark, folder)))


@query
def fold_statistics(spark, folder):
    """What preprocessing finds for each fold in the rows of the others: fills of categories, means and divisors of numbers."""
    table = stored(spark, folder)
    folded = stage(split.stratified_folds(table), "folds")
    rows = []
    for fold, model in enumerate(fold_fit.fit_folds(folded, preprocess.fit_binarizers(table), 3)):
        for step in model.stages:
            if isinstance(step, imputers.ModeImputerModel):
                rows += [(fold, name, fill, None, None) for name, fill in zip(step.getInputCols(), step.getOrDefault(step.fills))]
            if isinstance(step, encoding.PopulationScalerModel):
                rows += [(fold, name, None, *pair) for name, *pair in zip(
                    preprocess.SCALED, step.getOrDefault(step.means), step.getOrDefault(step.scales))]
    return rounded(spark.createDataFrame(rows, "fold int, name string, fill string, mean double, scale double"), 4)


@query
def class_weights(spark, folder):
    return rounded(search.class_weights(stage(features(spark, folder).select(LABEL))))


@query
def classification_metrics(spark, folder):
    guessed = features(spark, folder).select(
        F.col(LABEL).alias("label"), (F.col("ipo") | (F.col("total_rounds") >= 3)).alias("prediction"))
    return rounded(metrics.classification_metrics(guessed))


# Models.

def _parts(spark: SparkSession, folder: str):
    table = stored(spark, folder)
    parts = stage(split.stratified_split(table), "split")
    train, test = [parts.filter(F.col("split") == name).drop("split") for name in ("train", "test")]
    return table, train, test, preprocess.fit_binarizers(table)


def _scores(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """Test rows with the margin and the prediction of one grid point of a family."""
    _, train, test, binarizers = _parts(spark, folder)
    candidate = next(c for c in GRID_POINTS if c.family == family)
    scored = search.fit_model(train, binarizers, candidate).transform(test)
    return rounded(scored.select("company_id", LABEL, vector_to_array("rawPrediction")[1].alias("margin"), "prediction"), 4)


@query
def gbt_scores(spark, folder):
    return _scores(spark, folder, "gbt")


@query
def rff_svm_scores(spark, folder):
    return _scores(spark, folder, "rbf_svm")


@query
def poly_svm_scores(spark, folder):
    return _scores(spark, folder, "poly_svm")


@query
def mlp_scores(spark, folder):
    return _scores(spark, folder, "mlp")


@query
def grid_search(spark, folder):
    _, train, _, binarizers = _parts(spark, folder)
    found = search.grid_search(train, binarizers, search.full_grid())
    return rounded(found.scores.select("candidate", "family", "params", "mean_f1"))


@query
def evaluate(spark, folder):
    _, train, test, binarizers = _parts(spark, folder)
    return rounded(search.evaluate(search.fit_model(train, binarizers, GRID_POINTS[0]), test))


@query
def acquisition_chance(spark, folder):
    table, train, _, binarizers = _parts(spark, folder)
    return search.acquisition_chance(search.fit_model(train, binarizers, GRID_POINTS[0]), table)


@query
def calibrated_chance(spark, folder):
    """Chances from the margin of a given rule, calibrated on the rows themselves."""
    rule = F.col("total_rounds") + F.when(F.col("ipo"), 2.0).otherwise(0.0) - F.coalesce(F.col("age"), F.lit(0)) / F.lit(3650.0)
    scored = stage(features(spark, folder).select("company_id", F.col(LABEL).alias("label"), rule.alias("margin")), "rule")
    found = calibration.calibrate(scored, cells=40)
    return search.highest_chances(scored.where("company_id is not null").select("company_id", found.chance(F.col("margin")).alias("chance")))
