"""Precision, recall and F1 of the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _share(part: Column, whole: Column) -> Column:
    """Zero where undefined, as when nothing was predicted positive."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: tuple[str, ...] = ()) -> DataFrame:
    """One conditional count per outcome in one pass, then ratios; per group with ``by``."""
    actual, predicted = F.col(label).cast("boolean"), F.col(prediction).cast("boolean")
    counted = df.groupBy(*by).agg(F.count_if(actual & predicted).alias("tp"),
                                  F.count_if(~actual & predicted).alias("fp"),
                                  F.count_if(actual & ~predicted).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(*by, "tp", "fp", "fn", _share(tp, tp + fp).alias("precision"),
                          _share(tp, tp + fn).alias("recall"),
                          _share(2 * tp, 2 * tp + fp + fn).alias("f1"))
