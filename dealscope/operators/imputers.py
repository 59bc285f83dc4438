"""Stages that fill missing values."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from dealscope.functions.scalars import no_nan
from dealscope.operators.robust_line import fit_line
from dealscope.session import stage


class ConstantImputer(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replace gaps, or one given value instead, by a constant. A number that is none is a gap like NULL."""

    value = Param(Params._dummy(), "value", "replacement", TypeConverters.identity)
    missingValue = Param(Params._dummy(), "missingValue", "value to replace instead of gaps", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, value=0, missingValue=None):
        super().__init__()
        self._setDefault(value=0, missingValue=None)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gap, value = self.getOrDefault(self.missingValue), F.lit(self.getOrDefault(self.value))
        named = list(zip(self.getInputCols(), self.getOutputCols()))
        if gap is not None:
            return df.withColumns({out: F.when(F.col(n) == F.lit(gap), value).otherwise(F.col(n)) for n, out in named})
        numbers = {name for name, kind in df.dtypes if kind in ("double", "float")}
        return df.withColumns({out: F.coalesce(no_nan(F.col(n)) if n in numbers else F.col(n), value) for n, out in named})


class _FillParams(HasInputCols, HasOutputCols):
    fills = Param(Params._dummy(), "fills", "replacement per column", TypeConverters.toList)


class ModeImputer(Estimator, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill each column with its most frequent value; among equals the smallest."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        names = self.getInputCols()
        counted = (df.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names])))
            .filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n")))
        top = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("top"))
        found = {row["column"]: row["top"]["value"] for row in top.collect()}
        missing = [n for n in names if n not in found]
        if missing:
            raise ValueError(f"columns {missing} hold no value to fill with")
        return ModeImputerModel(inputCols=names, outputCols=self.getOutputCols(),
                                fills=[found[n] for n in names])


class ModeImputerModel(Model, _FillParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = self.getOrDefault(self.fills)
        return df.withColumns({out: F.coalesce(F.col(name), F.lit(fill)) for name, out, fill in
                               zip(self.getInputCols(), self.getOutputCols(), fills)})


class _LineParams(HasInputCol, HasOutputCol):
    """``inputCol`` drives the line; ``targetCol`` is the column with gaps."""

    targetCol = Param(Params._dummy(), "targetCol", "column to fill", TypeConverters.toString)
    gap = Param(Params._dummy(), "gap", "what counts as a gap: missing (NULL), or zero where the input is known",
                TypeConverters.toString)
    averaged = Param(Params._dummy(), "averaged", "fit on the mean per input value instead of on rows",
                     TypeConverters.toBoolean)
    slope = Param(Params._dummy(), "slope", "slope of the line", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept of the line", TypeConverters.toFloat)

    def _settings(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in (self.inputCol, self.targetCol, self.outputCol, self.gap, self.averaged)}


class LineImputer(Estimator, _LineParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fill the gaps of one column from another by a robust line over the rows without gaps."""

    @keyword_only
    def __init__(self, *, inputCol=None, targetCol=None, outputCol=None, gap="missing", averaged=False):
        super().__init__()
        self._setDefault(gap="missing", averaged=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LineImputerModel":
        x, y = self.getInputCol(), self.getOrDefault(self.targetCol)
        points = df.filter(F.col(y) != 0.0) if self.getOrDefault(self.gap) == "zero" else df
        if self.getOrDefault(self.averaged):
            points = stage(funds_by_rounds(points, x, y), "points")
        line = fit_line(points, x, y)
        return LineImputerModel(slope=line.slope, intercept=line.intercept, **self._settings())


class LineImputerModel(Model, _LineParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, targetCol=None, outputCol=None, gap=None, averaged=None, slope=None, intercept=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        x, y = F.col(self.getInputCol()), F.col(self.getOrDefault(self.targetCol))
        gap = (y == 0.0) & x.isNotNull() if self.getOrDefault(self.gap) == "zero" else y.isNull()
        line = F.lit(self.getOrDefault(self.slope)) * x + F.lit(self.getOrDefault(self.intercept))
        return df.withColumn(self.getOutputCol(), F.when(gap, line).otherwise(y))


def fund_imputer(out: str, rounds: str = "total_rounds", funded: str = "average_funded") -> LineImputer:
    """Missing money from the number of rounds, by a line through the mean per number."""
    return LineImputer(inputCol=rounds, targetCol=funded, outputCol=out, averaged=True)


def participants_imputer(out: str, funded: str = "average_funded", participants: str = "average_participants") -> LineImputer:
    """Zero participants of funded companies, by a line over the non-zero ones."""
    return LineImputer(inputCol=funded, targetCol=participants, outputCol=out, gap="zero")


def funds_by_rounds(df: DataFrame, rounds: str = "total_rounds", funded: str = "average_funded") -> DataFrame:
    """Mean money per number of rounds, over the numbers for which any money is known."""
    return (df.groupBy(rounds).agg(F.avg(funded).alias(funded))
            .filter(F.col(rounds).isNotNull() & F.col(funded).isNotNull()))
