"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run: its digests in order, one row per text with the smallest identifier and the
number of copies. Runs have addresses written in base ``fan``. In round r, each run is cut by the r-th digit of
the digests' prefix and the pieces are exchanged among the ``fan`` runs whose addresses differ in that
digit alone (a binomial exchange, for fan 2). Each receiver merges the sorted pieces and keeps, per text, the
smallest identifier. After the last round an address equals a digest prefix, so every text is in one place.
A text that a third of all rows share is one row per run from the first round on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dealscope.llm.tables import identity, join_hot, only, partitions, text_or_empty
from dealscope.session import stage

FAN = 8
WHITE = r"[\x20\x09-\x0D]+"

_RUN = "slot int, digest binary, check long, bytes int, copies long, ident long, pick long"


def normalised(text):
    return F.regexp_replace(text, WHITE, " ")


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pick, digest, check, bytes): the digest, and a second hash and the length that verify it."""
    plain = docs.select(F.col(key).cast("long").alias("ident"), normalised(text_or_empty(text)).alias("_text"))
    return plain.select(
        "ident", F.monotonically_increasing_id().alias("pick"),
        F.unhex(F.sha2("_text", 256)).alias("digest"), F.xxhash64("_text").alias("check"),
        F.octet_length("_text").alias("bytes"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapses neighbours of sorted rows that hold one text; the last one stays open for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            same = np.ones(table.num_rows - 1, bool)
            for name in ("slot", "digest", "check", "bytes"):
                column = table[name]
                same &= pc.equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = ~same
        first = np.flatnonzero(new)
        copies = np.add.reduceat(table["copies"].to_numpy(), first)
        merged = table.take(pa.array(first)).set_column(
            table.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
        rest = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def _digit(round_: int, fan: int):
    """The digit of the digest's 48-bit prefix that round ``round_`` looks at."""
    prefix = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return F.pmod(F.floor(prefix / F.lit(fan ** round_)), F.lit(fan)).cast("int")


def merge_runs(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(digest, check, bytes, copies, ident, pick): one row per text, by rounds of exchange and merge."""
    width = partitions(rows.sparkSession)
    rounds = 1
    while fan ** rounds < width:
        rounds += 1
    slots = fan ** rounds
    runs = rows.select(F.pmod(F.spark_partition_id(), F.lit(slots)).cast("int").alias("slot"),
                       "digest", "check", "bytes", F.lit(1).cast("long").alias("copies"), "ident", "pick")
    order = ["slot", "digest", "check", "bytes", F.asc_nulls_last("ident"), "pick"]
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merge, _RUN)
    for round_ in range(rounds):
        place = fan ** round_
        old = F.pmod(F.floor(F.col("slot") / place), F.lit(fan)).cast("int")
        runs = runs.withColumn("slot", (F.col("slot") + (_digit(round_, fan) - old) * place).cast("int"))
        # Short stretches of the digest order even out how addresses fall on tasks.
        stretch = F.substring("digest", 7, 1)
        runs = (runs.repartition(width, "slot", stretch)
                .sortWithinPartitions(*order).mapInArrow(_merge, _RUN))
    return runs.drop("slot")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", fan: int = FAN) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space; equality of
    digests is verified by length and a second hash. A null text counts as empty. Of equal texts the row with the
    smallest key stays (null keys last, then any one of repeated rows); keep_id is its key, null only if all keys of
    the group are null. Other columns of ``docs`` are ignored; an empty table gives an empty table.
    """
    rows = stage(digests(docs, key, text), "digests")
    groups = stage(merge_runs(rows, fan)
                   .withColumnsRenamed({"ident": "keep_id", "pick": "keep_pick", "copies": "group_size"}), "groups")
    joined = join_hot(rows, groups, ["digest", "check", "bytes"], "group_size", rows.count())
    return joined.select(
        F.col("ident").alias(key), "keep_id", "group_size", (F.col("pick") == F.col("keep_pick")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat both key and text are one document: one of them stays.
    """
    stay = exact_duplicates(docs, key, text).where("kept").withColumns(identity(key, F.col("text_sha256")))
    return only(docs, stay, key, F.sha2(normalised(text_or_empty(text)), 256))
