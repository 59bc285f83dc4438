"""Best-fit packing of token sequences, with matching of large items.

Only lengths matter for where a piece goes, and there are at most ``capacity`` of them. So the plan is made from
the histogram of lengths alone: large pieces (over a third of the capacity) are at most two in a bin and
are matched greedily, each with the longest partner that fits; smaller ones, longest first, go where they leave
the least room. The plan says for each length which ranks of its pieces go to which bins. Pieces then get
their rank and look the place up; no task sees more than its share of a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dealscope.llm.tables import partitions
from dealscope.llm.text import blocks
from dealscope.llm.tokens import ENCODE_BYTES, IdTable, library_encoder, shared
from dealscope.session import stage

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *[(at, capacity) for at in range(first, length, capacity)]]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document's ids followed by the end id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared(f"library {tokenizer}", lambda: IdTable(library_encoder(tokenizer)))
        for batch in batches:
            keys = batch.column(0)
            for first, part in blocks(batch.column(1), ENCODE_BYTES):
                rows, ids, bounds = table.texts(part)
                raw = memoryview(np.insert(ids, bounds[1:], END_ID).astype("<u4", copy=False).tobytes())
                bounds = bounds + np.arange(len(bounds))
                found: list[list] = [[], [], [], [], []]
                for row, begin, end in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for piece, (start, length) in enumerate(cut(end - begin, capacity)):
                        crc = zlib.crc32(raw[4 * (begin + start):4 * (begin + start + length)])
                        for column, value in zip(found, (first + row, piece, start, length, crc)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(found[0], pa.int64())), pa.array(found[1], pa.int32()),
                     *[pa.array(x, pa.int64()) for x in found[2:]]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        # The worker waits for other tasks, beside the executor's JVM, and needs no spare memory meanwhile.
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(encode, _PIECES)


class Plan:
    """Where the pieces of each length go.

    A rule (length, first rank, bins, per bin, first bin, offset) places ranks from its first one on: ``per bin`` in
    each of ``bins`` consecutive bins, from ``offset``. Groups of consecutive bins with the same room are kept together,
    so rules and groups number a few per length, however many pieces there are.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = dict(counts)
        self.placed = dict.fromkeys(counts, 0)
        self.rules: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.bins = 0
        large = sorted(length for length in counts if 3 * length > capacity)
        self._match(large)
        for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
            self._fit(length)

    def _put(self, length: int, first_bin: int, bins: int, per_bin: int, offset: int) -> None:
        self.rules.append((length, self.placed[length], bins, per_bin, first_bin, offset))
        self.placed[length] += bins * per_bin
        self.left[length] -= bins * per_bin

    def _open(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def _keep(self, room: int, first_bin: int, bins: int) -> None:
        if room and bins:
            if room not in self.groups:
                bisect.insort(self.rooms, room)
                self.groups[room] = []
            self.groups[room].append((first_bin, bins))

    def _take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room]
            self.rooms.pop(bisect.bisect_left(self.rooms, room))
        return group

    def _match(self, lengths: list[int]) -> None:
        """Longest first, each with the longest unmatched partner that fits beside it."""
        for length in reversed(lengths):
            while self.left[length]:
                at = bisect.bisect_right(lengths, min(self.capacity - length, length)) - 1
                while at >= 0 and not self.left[lengths[at]]:
                    at -= 1
                partner = lengths[at] if at >= 0 else None
                count = self.left[length]
                if partner is None or partner == length and count == 1:
                    smaller = at - 1 if partner is not None else -1
                    while smaller >= 0 and not self.left[lengths[smaller]]:
                        smaller -= 1
                    partner = lengths[smaller] if smaller >= 0 else None
                if partner is None:
                    first = self._open(count)
                    self._put(length, first, count, 1, 0)
                    self._keep(self.capacity - length, first, count)
                elif partner == length:
                    first = self._open(count // 2)
                    self._put(length, first, count // 2, 2, 0)
                    self._keep(self.capacity - 2 * length, first, count // 2)
                else:
                    count = min(count, self.left[partner])
                    first = self._open(count)
                    self._put(length, first, count, 1, 0)
                    self._put(partner, first, count, 1, length)
                    self._keep(self.capacity - length - partner, first, count)

    def _fit(self, length: int) -> None:
        while self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            room = self.rooms[at] if at < len(self.rooms) else self.capacity
            per_bin = room // length
            count = self.left[length]
            bins, rest = divmod(count, per_bin)
            if at < len(self.rooms):
                first, size = self._take(room)
                bins = min(bins, size)
                if not bins:
                    bins, per_bin = 1, rest
                self._keep(room, first + bins, size - bins)
            else:
                if not bins:
                    bins, per_bin = 1, rest
                first = self._open(bins)
            self._put(length, first, bins, per_bin, self.capacity - room)
            self._keep(room - per_bin * length, first, bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: every sequence is gapless from 0 and holds ``capacity`` at most.

    ``pieces`` needs doc_id, piece and length (1 to ``capacity``); equal rows are separate pieces, doc_id may be null.
    No rows give no rows.
    """
    spark = pieces.sparkSession
    chunks = partitions(spark)
    rows = stage(pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int")), "pieces")
    # At most capacity x chunks rows, whatever the input.
    counts = stage(rows.groupBy("length", "_chunk").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece")
    ranked = (rows.withColumn("_row", F.row_number().over(inside))
              .join(offsets, ["length", "_chunk"])
              .withColumn("_rank", (F.col("_before") + F.col("_row") - 1).cast("long"))
              .drop("_row", "_before", "_chunk"))

    rules = np.array(sorted(plan.rules), np.int64).reshape(-1, 6)
    shift = np.int64(40)
    starts = (rules[:, 0] << shift) + rules[:, 1]
    shared = spark.sparkContext.broadcast((rules, starts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, starts = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            if not len(rank):
                continue
            rule = rules[np.searchsorted(starts, (length << shift) + rank, "right") - 1]
            inner = rank - rule[:, 1]
            names = [name for name in batch.schema.names if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(rule[:, 4] + inner // rule[:, 3]),
                 pa.array(rule[:, 5] + inner % rule[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    packed = ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    return packed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its ids by ``tokenizer`` (strings of special tokens being ordinary text) followed by id 0, so a null or empty text is one token. Longer documents are cut
    into pieces of ``capacity``; the first may be shorter. Repeated rows and null keys are documents of their own; other
    columns are ignored; no rows give no rows.
    """
    return pack(token_pieces(docs, tokenizer, capacity, key, text), capacity)
