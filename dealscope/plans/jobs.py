"""The three jobs: extract features, explore them, fit and score a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscope.functions.scalars import DEFAULT_AS_OF
from dealscope.operators import explore
from dealscope.operators.calibration import calibrate
from dealscope.operators.cleaning import company_features
from dealscope.operators.preprocess import fit_binarizers
from dealscope.operators.search import (FIT_PARTITIONS, Candidate, acquisition_chance, evaluate, full_grid, grid_search,
                                        held_out_margins)
from dealscope.operators.split import stratified_split, train_columns
from dealscope.sources.files import read_part, write_csv, write_split
from dealscope.sources.tables import SourceTables

FEATURES_PATH, SPLIT_PATH = "features", "split"


def feature_job(tables: SourceTables, folder: str, as_of: str = DEFAULT_AS_OF, test_size: float = 0.2,
                seed: int = 0, csv: bool = False) -> DataFrame:
    """Write the feature table and its train / test parts below ``folder``.

    Parquet is the store of the later jobs; ``csv`` adds the same files as text. Train and
    test go to separate folders, so fitting never reads test rows.
    """
    spark = tables.objects.sparkSession
    company_features(tables, as_of).write.mode("overwrite").parquet(f"{folder}/{FEATURES_PATH}")
    features = spark.read.parquet(f"{folder}/{FEATURES_PATH}")
    split = train_columns(stratified_split(features, test_size, seed=seed))
    write_split(split, f"{folder}/{SPLIT_PATH}")
    if csv:
        write_csv(features, f"{folder}/{FEATURES_PATH}_csv")
        write_split(split, f"{folder}/{SPLIT_PATH}_csv", format="csv")
    return features


def explore_job(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All profiles of a written feature table, each a lazy DataFrame over the stored columns it needs."""
    features = spark.read.parquet(f"{folder}/{FEATURES_PATH}")
    aged = explore.known_age(features)
    return {
        "profile": explore.profile(features),
        "age_rates": explore.age_rates(features), "age_counts": explore.age_counts(features),
        "known_age_rates": explore.age_rates(aged), "known_age_counts": explore.age_counts(aged),
        "category_rates": explore.category_rates(aged),
        "correlations": explore.correlations(aged),
        "histograms": explore.histograms(aged), "pair_histograms": explore.pair_histograms(aged),
        "completeness": explore.completeness(aged),
    }


def model_job(spark: SparkSession, folder: str, candidates: Sequence[Candidate] | None = None,
              folds: int = 3, parallelism: int = 4, seed: int = 0, partitions: int = FIT_PARTITIONS) -> tuple[DataFrame, PipelineModel]:
    """Search on the train part, report on the test part, store the model, scores and chances.

    Returns one report row: best score and parameters, and the metrics on the test part.
    """
    features = spark.read.parquet(f"{folder}/{FEATURES_PATH}")
    train = read_part(spark, f"{folder}/{SPLIT_PATH}", "train")
    test = read_part(spark, f"{folder}/{SPLIT_PATH}", "test")
    found = grid_search(train, fit_binarizers(features), list(candidates or full_grid()), folds,
                        parallelism, seed=seed, folder=f"{folder}/fold_scores", partitions=partitions)
    found.scores.write.mode("overwrite").parquet(f"{folder}/scores")
    found.model.write().overwrite().save(f"{folder}/model")
    calibration = None
    if not hasattr(found.model.stages[-1], "getProbabilityCol"):
        calibration = calibrate(held_out_margins(train, fit_binarizers(features), found.best, folds, seed=seed, partitions=partitions))
    acquisition_chance(found.model, features, calibration=calibration).write.mode("overwrite").parquet(f"{folder}/chances")
    report = evaluate(found.model, test).select(
        F.lit(found.best.family).alias("family"), F.lit(str(found.best)).alias("params"),
        F.lit(found.best_score).alias("best_score"), "precision", "recall", "f1")
    return report, found.model
