"""Comparison of a Spark result with the same SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {table} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE"}


def differences(df, con, text: str) -> list[str]:
    """Human-readable differences in names, types and values; empty when equal."""
    result = con.execute(text)
    theirs = {d[0]: str(d[1]) for d in result.description}
    ours = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    found = [f"{name}: spark {ours.get(name)} duckdb {theirs.get(name)}"
             for name in sorted(set(ours) | set(theirs)) if ours.get(name) != theirs.get(name)]
    left = _rows(list(ours), df.collect())
    right = _rows(list(theirs), result.fetchall())
    if len(left) != len(right):
        found.append(f"rows: spark {len(left)} duckdb {len(right)}")
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        found.append(f"{len(unequal)} unequal rows, first {unequal[0]}")
    return found
