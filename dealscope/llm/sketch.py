"""Threshold-scaled document fingerprints.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text and
fingerprints of very unequal texts stay comparable: the kept hashes of a part are those of the whole that lie in
the part. The smallest hash is always kept, so only texts without words have an empty fingerprint. Fingerprints
merge: the union of two, without a smallest hash that is no longer the smallest, is that of both texts together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealscope.llm.tables import partitions
from dealscope.llm.text import blocks, shingle_sets

FRACTION = 1 / 8
DIGITS = 12
#: Slices of the order for each shuffle partition, so that hashing them to partitions evens out.
SLICES = 8
NULL_SLICES = 16

_BITS = 4 * DIGITS


def limit(fraction: float) -> int:
    return int(fraction * (1 << _BITS))


def sketches(texts: pa.Array, fraction: float = FRACTION) -> list[np.ndarray]:
    """Sorted kept hashes of each text."""
    hashes, offsets = shingle_sets(texts)
    short = hashes >> np.uint64(64 - _BITS)
    below = short < np.uint64(limit(fraction))
    first = offsets[:-1][np.diff(offsets) > 0]
    below[first] = True
    kept = np.concatenate([[0], np.cumsum(below)])[offsets]
    short = short[below]
    return [short[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist())]


def encode(sketch: np.ndarray) -> str:
    """Fixed-width lower-case hexadecimal numbers in order, without separators."""
    return (sketch << np.uint64(64 - _BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :DIGITS // 2].tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, DIGITS // 2)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - DIGITS // 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(one: np.ndarray, other: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The fingerprint of both texts' shingles together."""
    union = np.union1d(one, other)
    return union[(union < np.uint64(limit(fraction))) | (np.arange(len(union)) == 0)]


def likeness(one: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Estimates of the Jaccard similarity and of the share of ``one`` contained in ``other``.

    Two empty fingerprints are alike (1, 1); an empty and another one are not (0, 0).
    """
    if not len(one) or not len(other):
        same = float(len(one) == len(other))
        return same, same
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both), both / len(one)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("within_edited", pa.float64()), ("within_next", pa.float64())]
_OUT_SQL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, within_edited double, within_next double")


def _compare(keys: list, texts: list[str], own: list[np.ndarray], following: list[str],
             following_sketch: list[np.ndarray], fraction: float) -> list[list]:
    edited = [edit(a, b) for a, b in zip(texts, following)]
    changed = sketches(pa.array(edited, pa.large_string()), fraction)
    to_edited = [likeness(a, b) for a, b in zip(own, changed)]
    to_next = [likeness(a, b) for a, b in zip(own, following_sketch)]
    return [keys, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [encode(s) for s in own], [encode(s) for s in changed],
            [x for x, _ in to_edited], [x for x, _ in to_next], [x for _, x in to_edited], [x for _, x in to_next]]


def _batch(columns: list[list]) -> list[pa.Array]:
    return [pa.array(values, kind) for values, (_, kind) in zip(columns, _OUT)]


def _slice_of(splits: np.ndarray):
    """Column function: the slice of the order that a row belongs to; null keys are spread over the first ones."""
    @F.pandas_udf("int")
    def place(none: pd.Series, order: pd.Series) -> pd.Series:
        values = order.to_numpy(np.int64)
        by_key = NULL_SLICES + np.searchsorted(splits, values, "left")
        by_hash = (values >> 32) * NULL_SLICES // (1 << 32) + NULL_SLICES // 2
        return pd.Series(np.where(none.to_numpy(bool), by_hash, by_key))
    return place


def fingerprints(docs: DataFrame, fraction: float = FRACTION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document is the one with the next key in ascending order (null keys come first, in the order of a hash of
    their texts; equal keys are ordered by text), after the last the first; a single document follows itself. A null text
    counts as empty, with an empty fingerprint. near_* are Jaccard estimates, within_* the shares of the document's shingles
    found there. Other columns are ignored; no rows give no rows.

    The order is cut into slices at quantiles of the key. Each slice also gets a copy of the first row of the next
    one, so a task compares neighbours as they pass in one sorted stream.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    plain = plain.withColumns({"none": F.col("doc_id").isNull(), "order": F.coalesce("doc_id", F.xxhash64("text"))})
    points = [i / (SLICES * width) for i in range(1, SLICES * width)]
    splits = plain.agg(F.percentile_approx("doc_id", points, 10 * SLICES * width).alias("at")).first()["at"]
    rows = plain.withColumn("slice", _slice_of(np.unique(np.array(splits or [], np.int64)))("none", "order"))
    # Two numbers per slice.
    heads = sorted((r["slice"], r["first"]) for r in rows.groupBy("slice").agg(F.min("order").alias("first")).collect())
    before = [heads[i - 1][0] for i in range(len(heads))]
    copied = spark.createDataFrame([(*head, to) for head, to in zip(heads, before)], "slice int, order long, copy_to int")
    places = F.array(F.struct(F.col("slice").alias("slice"), F.lit(False).alias("is_copy")))
    copy = F.array(F.struct(F.col("copy_to").alias("slice"), F.lit(True).alias("is_copy")))
    placed = (rows.join(F.broadcast(copied), ["slice", "order"], "left")
              .withColumn("_p", F.explode(F.when(F.col("copy_to").isNull(), places).otherwise(F.concat(places, copy))))
              .select("doc_id", "order", "text", "_p.slice", "_p.is_copy"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                part = [batch.column(name).slice(first, len(texts)).to_pylist() for name in ("doc_id", "slice", "is_copy")]
                stream = [*last, *zip(*part, texts.to_pylist(), sketches(texts, fraction))]
                last = stream[-1:]
                # A copy is no document here, and no neighbour of the rows that come after it.
                pairs = [(a, b) for a, b in zip(stream, stream[1:]) if not a[2] and a[1] == b[1]]
                done = _compare([a[0] for a, _ in pairs], [a[3] for a, _ in pairs], [a[4] for a, _ in pairs],
                                [b[3] for _, b in pairs], [b[4] for _, b in pairs], fraction)
                yield pa.RecordBatch.from_arrays(_batch(done), names=[name for name, _ in _OUT])

    return (placed.repartition(width, "slice").sortWithinPartitions("slice", "is_copy", "order", "text")
            .mapInArrow(scan, _OUT_SQL))
