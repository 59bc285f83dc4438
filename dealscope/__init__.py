"""Company-acquisition analytics as Spark DataFrame, SQL and ML jobs."""

__version__ = "0.1.0"
