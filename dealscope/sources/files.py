"""Feature tables as CSV and parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dealscope.schemas import features_schema

# Quotes inside a field are doubled, as other CSV writers do; missing values are empty fields.
CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""'}


def write_csv(df: DataFrame, path: str) -> None:
    """Write with a header line."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def _typed(name: str, kind: T.DataType) -> Column:
    """A field as ``kind``; one that cannot be is an error, not NULL. Whole numbers may be written like 3.0."""
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return text
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: "), text)).cast(kind)
    value = text.try_cast(kind)
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(kind)))
    return F.when(text.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(value, wrong))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read with declared types. Columns are found by the names in the header, in whatever order they are.

    Columns of the file that ``schema`` lacks come last, as text; a column of ``schema`` that the file lacks is an error, as
    is a field that does not fit its type.
    """
    schema = schema or features_schema()
    text = spark.read.options(**CSV).option("mode", "FAILFAST").csv(path)
    more = [name for name in text.columns if name not in schema.fieldNames()]
    return text.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema], *[F.col(f"`{name}`") for name in more])


def write_split(df: DataFrame, path: str, column: str = "split", format: str = "parquet") -> None:
    """Write all parts in one pass, one folder per part."""
    options = CSV if format == "csv" else {}
    df.write.mode("overwrite").format(format).options(**options).partitionBy(column).save(path)


def read_part(spark: SparkSession, path: str, part: str, schema: T.StructType | None = None,
              column: str = "split", format: str = "parquet") -> DataFrame:
    """Read one part of a written split, its columns in the order they were written."""
    folder = f"{path}/{column}={part}"
    if format == "csv":
        typed = read_csv(spark, folder, schema)
        return typed if schema else typed.select(*spark.read.options(**CSV).csv(folder).columns)
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema is not None else reader).load(folder)
