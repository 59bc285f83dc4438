"""Sessions, and the shared folder that intermediate tables are staged in."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_folders: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "dealscope", memory: str = "8g", **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a session whose driver and executors are one process, as in tests, gets a temporary folder if it names none. On
    a cluster, also one of several processes on one machine, a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SHARED_DIR_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="dealscope-")
        folder = f"file://{_own_folders[context.applicationId]}"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write ``df`` as parquet in the shared folder, with ``file_rows`` at most in a file if given, and read it back.

    Cuts the lineage and outlives lost executors; unlike an RDD checkpoint the result
    keeps column pruning and filter push-down for the passes that follow.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are started inside hand Python ``rows`` rows at a time, or fewer where the session says so."""
    before = spark.conf.get(BATCH_KEY)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)
