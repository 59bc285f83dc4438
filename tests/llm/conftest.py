import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from llm_rows import ODD, documents  # noqa: E402


@pytest.fixture
def odd(spark):
    """Odd rows, with extra columns that clash with names inside the operators."""
    extra = ("_key", "_none", "_content", "node", "digest", "row", "group", "slot", "rank", "length", "piece", "none", "order",
             "slice", "content", "size", "value", "kind", "_entities", "copies", "doc", "codes", "labels")
    return documents(spark, ODD).withColumns({name: F.lit(7) for name in extra})


@pytest.fixture
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def sample(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
