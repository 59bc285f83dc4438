"""The seven source tables, from a catalogue database, parquet folders or a relational server."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dealscope.functions.scalars import no_nan, parse_date
from dealscope.schemas import DATE_COLUMNS, SOURCE_COLUMNS

DEFAULT_PREFIX = "cb_"


@dataclass(frozen=True)
class SourceTables:
    objects: DataFrame
    funding_rounds: DataFrame
    acquisitions: DataFrame
    ipos: DataFrame
    offices: DataFrame
    relationships: DataFrame
    degrees: DataFrame

    @classmethod
    def load(cls, read: Callable[[str], DataFrame]) -> "SourceTables":
        """Build all tables with ``read(name)``, each narrowed to the columns jobs use."""
        return cls(**{name: conform(name, read(name)) for name in SOURCE_COLUMNS})


def conform(name: str, df: DataFrame) -> DataFrame:
    """Pick the used columns, type dates, and turn NaN into NULL. Keys keep their type."""
    missing = [c for c in SOURCE_COLUMNS[name] if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks columns {missing}")
    picked = []
    for column in SOURCE_COLUMNS[name]:
        value, kind = F.col(column), df.schema[column].dataType
        if column in DATE_COLUMNS and isinstance(kind, T.StringType):
            value = parse_date(value)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = no_nan(value.cast("double"))
        picked.append(value.alias(column))
    return df.select(*picked)


def from_database(spark: SparkSession, database: str, prefix: str = DEFAULT_PREFIX) -> SourceTables:
    return SourceTables.load(lambda name: spark.table(f"{database}.{prefix}{name}"))


def from_parquet(spark: SparkSession, folder: str, prefix: str = DEFAULT_PREFIX) -> SourceTables:
    return SourceTables.load(lambda name: spark.read.parquet(f"{folder}/{prefix}{name}"))


# Key whose checksum spreads a relational table over reading tasks.
SPREAD_KEYS = {
    "objects": "id", "funding_rounds": "object_id", "acquisitions": "acquiring_object_id",
    "ipos": "object_id", "offices": "object_id", "relationships": "person_object_id",
    "degrees": "object_id",
}


def checksum_predicates(column: str, parts: int) -> list[str]:
    """One WHERE clause per reading task. Works for text keys; NULL keys go to part 0."""
    return [f"MOD(COALESCE(CRC32({column}), 0), {parts}) = {part}" for part in range(parts)]


def read_jdbc(spark: SparkSession, url: str, database: str, name: str, parts: int,
              properties: dict[str, str] | None = None, prefix: str = DEFAULT_PREFIX,
              bounds: tuple[str, int, int] | None = None) -> DataFrame:
    """Read one table over ``parts`` connections.

    ``bounds=(column, low, high)`` splits by ranges of a numeric column, which an index can
    serve; without it the split is by checksum of the table's key, so that no single
    connection carries a whole table.
    """
    table = f"{database}.{prefix}{name}"
    if bounds:
        column, low, high = bounds
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high,
                               numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, table, predicates=checksum_predicates(SPREAD_KEYS[name], parts),
                           properties=properties)


def land_jdbc(spark: SparkSession, url: str, database: str, folder: str, parts: int = 64,
              properties: dict[str, str] | None = None, prefix: str = DEFAULT_PREFIX) -> SourceTables:
    """Copy all tables from a relational server to parquet once, and read them from there."""
    remote = SourceTables.load(
        lambda name: read_jdbc(spark, url, database, name, parts, properties, prefix))
    return land_parquet(remote, folder, prefix)


def land_parquet(tables: SourceTables, folder: str, prefix: str = DEFAULT_PREFIX) -> SourceTables:
    for name in SOURCE_COLUMNS:
        getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{prefix}{name}")
    return from_parquet(tables.objects.sparkSession, folder, prefix)


def land_database(tables: SourceTables, database: str, buckets: int | None = None,
                  prefix: str = DEFAULT_PREFIX) -> SourceTables:
    """Save all tables in a catalogue database.

    ``buckets`` pre-partitions ``objects`` by its unique id, which takes its exchange out of
    every later join. The event tables stay unbucketed on purpose: a bucket is read by one
    task, and a company holding a large share of the events would make that task the job.
    """
    spark = tables.objects.sparkSession
    for name in SOURCE_COLUMNS:
        writer = getattr(tables, name).write.mode("overwrite").format("parquet")
        if buckets and name == "objects":
            writer = writer.bucketBy(buckets, "id").sortBy("id")
        writer.saveAsTable(f"{database}.{prefix}{name}")
    return from_database(spark, database, prefix)
