"""Hard negatives: for an anchor and each of its positives, the best rows of other labels inside a window of scores.

Scores are inner products of integer vectors. Rows are packed into an R-tree by Sort-Tile-Recursive, the label being the first
coordinate: a range partitioning by label, widest coordinate and a hash of the identifier makes subtrees of some
SUBTREE_ROWS rows, also where many rows are equal. Inside one, rows are sorted and tiled along the widest coordinates in turn, leaves hold
LEAF_ROWS rows, and nodes FAN_OUT nodes. Every node has the smallest and largest label and coordinates below it.

An anchor's inner product with any row of a node lies between the sums of the smaller and the larger products of its coordinates with the node's.
The search of a subtree is best first: a queue yields the node of highest upper bound; a node is passed over if its labels cannot
match, if its interval lies outside the window, or if it is strictly below the kth score found; ties are followed up. An anchor visits the
subtrees whose labels can match, so subtrees within one label serve their own anchors' positives and all others' negatives. Anchors travel in
blocks of ANCHOR_BLOCK; a task searches one subtree for one block, and windows merge the subtrees' best rows. Negatives are searched for twice: first
in a small tree of one row in SCOUTS, whose kth score for a window is a floor that holds for the whole table, then in the whole
tree from that floor on, so that subtrees neither open nor return what cannot be among the best. Bounds and scores are exact:
doubles where every sum stays below 2^53, unbounded integers elsewhere.

Rows: rows with a null identifier, label or vector, or any null or non-finite component take no part; nor do rows whose squared length,
scaled, is 2^62 or more, as their scores leave 64 bits. Of several rows with one identifier the one of smallest label, then smallest vector,
counts. A vector shorter than another counts as if followed by zeros. An anchor without positives, or a positive without
negatives in its window, has no rows. Columns of other names play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dealscope.session import stage

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
SUBTREE_ROWS = 4096
LEAF_ROWS = 128
FAN_OUT = 8
#: Coordinates along which a subtree is tiled.
TILED = 3
ANCHOR_BLOCK = 2048
SCOUTS = 16
_EXACT = 2.0 ** 53


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of integers as rows of one matrix, zeros after the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values, sizes = column.values.to_numpy(), np.diff(offsets)
    out = np.zeros((len(column), max(width, sizes.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0]:offsets[-1]]
    return out


def tile(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Order of the rows in which consecutive runs of ``leaf`` rows are the tree's leaves (Leutenegger and others 1997)."""
    wide = np.argsort(-vectors.astype(float).var(axis=0), kind="stable")[:TILED] if len(vectors) else []
    axes = [labels, *(vectors[:, i] for i in wide)]

    def cut(rows: np.ndarray, axis: int) -> list[np.ndarray]:
        rows = rows[np.lexsort((ids[rows], axes[axis][rows]))]
        leaves = ceil(len(rows) / leaf)
        if axis + 1 == len(axes) or leaves <= 1:
            return [rows]
        slabs = ceil(leaves ** (1 / (len(axes) - axis)))
        size = leaf * ceil(leaves / slabs)
        return [part for at in range(0, len(rows), size) for part in cut(rows[at:at + size], axis + 1)]

    return np.concatenate(cut(np.arange(len(vectors)), 0)) if len(vectors) else np.zeros(0, np.int64)


class Subtree:
    """Rows in the order of their leaves, with the boxes of all nodes, level by level from the leaves up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.starts = np.arange(0, len(ids), LEAF_ROWS)
        boxes = [np.minimum.reduceat(vectors, self.starts), np.maximum.reduceat(vectors, self.starts),
                 np.minimum.reduceat(labels, self.starts), np.maximum.reduceat(labels, self.starts)]
        levels = [boxes]
        while len(levels[-1][0]) > 1:
            at = np.arange(0, len(levels[-1][0]), FAN_OUT)
            levels.append([(np.minimum, np.maximum)[i % 2].reduceat(box, at) for i, box in enumerate(levels[-1])])
        self.sizes = [len(level[0]) for level in levels]
        self.bases = np.cumsum([0, *self.sizes])
        self.low, self.high, self.label_low, self.label_high = (np.concatenate(parts) for parts in zip(*levels))
        self.root = self.bases[-1] - 1
        self.largest = float(np.abs(vectors).max(initial=0))

    def kind(self, anchors: np.ndarray) -> type:
        """The number type in which all scores and bounds are exact."""
        most = float(np.abs(anchors).max(initial=0)) * self.largest * max(1, anchors.shape[1])
        return np.float64 if most < _EXACT else object

    def prepared(self, kind: type) -> "Subtree":
        out = object.__new__(Subtree)
        out.__dict__.update(self.__dict__)
        out.vectors, out.low, out.high = (part.astype(kind) for part in (self.vectors, self.low, self.high))
        return out

    def children(self, node: int) -> range:
        level = int(np.searchsorted(self.bases, node, "right")) - 1
        first = (node - self.bases[level]) * FAN_OUT
        return range(self.bases[level - 1] + first, self.bases[level - 1] + min(first + FAN_OUT, self.sizes[level - 1]))


class Search:
    """One anchor against one subtree; leaves' scores are kept for its further searches."""

    def __init__(self, tree: Subtree, anchor: np.ndarray):
        self.tree, self.anchor = tree, anchor
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        self.upper = tree.high @ up + tree.low @ down
        self.lower = tree.low @ up + tree.high @ down
        self.known: dict[int, np.ndarray] = {}

    def scores(self, leaf: int) -> np.ndarray:
        if leaf not in self.known:
            start = self.tree.starts[leaf]
            self.known[leaf] = self.tree.vectors[start:start + LEAF_ROWS] @ self.anchor
        return self.known[leaf]

    def best(self, label: int, same: bool, count: int, low: int | None = None, high: int | None = None,
             leave_out: int | None = None) -> list[tuple[int, int]]:
        """The ``count`` best (score, id) of rows with this label, or of all others, with scores from ``low`` to ``high``."""
        tree, found = self.tree, []

        def wait(node: int) -> None:
            if same and not tree.label_low[node] <= label <= tree.label_high[node]:
                return
            if not same and tree.label_low[node] == tree.label_high[node] == label:
                return
            if low is not None and (self.upper[node] < low or self.lower[node] > high):
                return
            bound = self.upper[node] if high is None else min(self.upper[node], high)
            if len(found) < count or bound >= found[0][0]:
                heapq.heappush(waiting, (-bound, node))

        waiting: list[tuple] = []
        wait(tree.root)
        while waiting:
            bound, node = heapq.heappop(waiting)
            if len(found) == count and -bound < found[0][0]:
                break
            if node >= tree.sizes[0]:
                for child in tree.children(node):
                    wait(child)
                continue
            scores = self.scores(node)
            rows = slice(tree.starts[node], tree.starts[node] + len(scores))
            fit = (tree.labels[rows] == label) == same
            if low is not None:
                fit &= (scores >= low) & (scores <= high)
            if len(found) == count:
                fit &= scores >= found[0][0]
            if leave_out is not None:
                fit &= tree.ids[rows] != leave_out
            at = np.flatnonzero(fit.astype(bool))
            if len(at) > count:
                at = at[np.lexsort((tree.ids[rows][at], -scores[at]))[:count]]
            for i in at.tolist():
                own = (int(scores[i]), -int(tree.ids[rows][i]))
                if len(found) < count:
                    heapq.heappush(found, own)
                elif own > found[0]:
                    heapq.heapreplace(found, own)
        return [(score, -key) for score, key in found]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest whole score from ``low`` to ``high`` percent of ``score``."""
    return -(-low * score // 100), high * score // 100


_ROWS = "id bigint, label bigint, vector array<bigint>"


def integer_rows(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """id, label and the scaled, rounded-down components of the rows that take part, one row per id."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    plain = rows.select(F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("raw"), scaled.alias("scaled"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("scaled", F.lit(0.0), lambda total, x: total + x * x)
    whole = F.transform("scaled", lambda x: x.cast("bigint"))
    kept = plain.where("id is not null and label is not null and raw is not null").where(~bad).where(length < 2.0 ** 62)
    chosen = kept.select("id", F.struct("label", whole.alias("vector")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return chosen.select("id", "row.label", "row.vector")


def pack(rows: DataFrame) -> DataFrame:
    """Leaves in order: subtree, label, ids, vectors as bytes. ``rows`` are stored id, label, vector."""
    width = F.posexplode("vector").alias("at", "x")
    widest = rows.select(width).groupBy("at").agg(F.var_pop("x").alias("v")).orderBy(F.desc("v"), "at").first()
    along = F.get("vector", F.lit(widest["at"] if widest else 0))
    parts = max(1, ceil(rows.count() / SUBTREE_ROWS))
    dealt = rows.repartitionByRange(parts, "label", F.coalesce(along, F.lit(0)), F.xxhash64("id"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        ids, labels = whole["id"].to_numpy(), whole["label"].to_numpy()
        vectors = matrix(whole["vector"])
        order = tile(vectors, labels, ids)
        starts = np.arange(0, len(order), LEAF_ROWS)
        parts = [order[at:at + LEAF_ROWS] for at in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts))), pa.array([ids[p] for p in parts], pa.list_(pa.int64())),
             pa.array([labels[p] for p in parts], pa.list_(pa.int64())),
             pa.array([vectors[p].astype("<i8").tobytes() for p in parts], pa.binary())], ["leaf", "ids", "labels", "vectors"])

    packed = dealt.mapInArrow(leaves, "leaf bigint, ids array<bigint>, labels array<bigint>, vectors binary")
    return packed.withColumn("subtree", F.spark_partition_id())


def unpack(leaves: pa.Table) -> Subtree:
    leaves = leaves.sort_by("leaf")
    ids = np.concatenate([np.asarray(part, np.int64) for part in leaves["ids"].to_pylist()])
    labels = np.concatenate([np.asarray(part, np.int64) for part in leaves["labels"].to_pylist()])
    vectors = np.frombuffer(b"".join(leaves["vectors"].to_pylist()), "<i8").reshape(len(ids), -1)
    return Subtree(ids, labels, vectors)


def _searches(tree: Subtree, anchors: np.ndarray) -> Iterator[Search]:
    """A search for each anchor; anchors longer than all rows are cut, as the rest meets zeros only."""
    width = tree.vectors.shape[1]
    anchors = anchors[:, :width] if anchors.shape[1] >= width else np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
    kind = tree.kind(anchors)
    tree = tree.prepared(kind)
    for anchor in anchors.astype(kind):
        yield Search(tree, anchor)


def _visit(tree: DataFrame, anchors: DataFrame, blocks: int, search, schema: str) -> DataFrame:
    """Run ``search`` on each subtree and each block of the anchors that visit it."""
    left = tree.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    empty = pa.schema([(name, pa.int64()) for name in (part.split()[0] for part in schema.split(", "))])

    def run(leaves: pa.Table, visitors: pa.Table) -> pa.Table:
        if not leaves.num_rows or not visitors.num_rows:
            return empty.empty_table()
        rows = list(search(unpack(leaves), visitors))
        return pa.table([pa.array(column, pa.int64()) for column in zip(*rows)], schema=empty) if rows else empty.empty_table()

    return left.groupBy("subtree", "block").cogroup(right.groupBy("subtree", "block")).applyInArrow(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
                   scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``, the key as a long.
    """
    own = stage(integer_rows(rows, key, vector, F.col("label") if label is None else label, scale), "vectors")
    tree = stage(pack(own), "leaves")
    anchors = own.where(is_anchor)
    blocks = max(1, ceil(anchors.count() / ANCHOR_BLOCK))
    spans = tree.select("subtree", F.explode("labels").alias("label")).groupBy("label").agg(
        F.min("subtree").alias("first"), F.max("subtree").alias("last"))
    placed = stage(anchors.join(spans, "label"), "anchors")

    def nearest(subtree: Subtree, visitors: pa.Table) -> Iterator[tuple]:
        names = zip(visitors["id"].to_pylist(), visitors["label"].to_pylist())
        for (anchor, kind), search in zip(names, _searches(subtree, matrix(visitors["vector"]))):
            for score, other in search.best(kind, True, positives, leave_out=anchor):
                yield anchor, other, score

    at_home = placed.withColumn("subtree", F.explode(F.sequence("first", "last"))).select("id", "label", "vector", "subtree")
    near = _visit(tree, at_home, blocks, nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stage(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "positives")

    def harder(subtree: Subtree, visitors: pa.Table) -> Iterator[tuple]:
        names = zip(visitors["id"].to_pylist(), visitors["label"].to_pylist(), visitors["positives"].to_pylist())
        for (anchor, kind, own_positives), search in zip(names, _searches(subtree, matrix(visitors["vector"]))):
            for positive in own_positives:
                score = positive["positive_score"]
                least, most = window(score, low, high)
                for found, other in search.best(kind, False, negatives, max(least, positive["floor"] or least), most):
                    yield anchor, positive["positive_id"], score, other, found

    asked = chosen.where("positive_score >= 0")
    found_columns = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")

    def visit(trees: DataFrame, wanted: DataFrame, end: int, own_label: Column) -> DataFrame:
        """The best negatives of ``trees`` for each anchor and its positives, which are ``wanted`` with a floor."""
        grouped = wanted.groupBy(F.col("anchor_id").alias("id")).agg(
            F.collect_list(F.struct("positive_id", "positive_score", "floor")).alias("positives"))
        visitors = placed.join(grouped, "id").withColumn("subtree", F.explode(F.sequence(F.lit(0), F.lit(end)))).where(~own_label)
        found = _visit(trees, visitors.select("id", "label", "vector", "positives", "subtree"), blocks, harder, found_columns)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    scouts = stage(pack(own.where(F.pmod(F.xxhash64("id"), F.lit(SCOUTS)) == 0)), "scouts")
    first = visit(scouts, asked.withColumn("floor", F.lit(None).cast("bigint")), _last(scouts), F.lit(False))
    floors = first.where(F.col("rank") == negatives).select("anchor_id", "positive_id", F.col("negative_score").alias("floor"))
    known = stage(asked.join(floors, ["anchor_id", "positive_id"], "left"), "floors")
    # Subtrees strictly between a label's first and last hold nothing but that label.
    within = (F.col("subtree") > F.col("first")) & (F.col("subtree") < F.col("last"))
    return visit(tree, known, _last(tree), within).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _last(tree: DataFrame) -> int:
    return tree.agg(F.coalesce(F.max("subtree"), F.lit(0))).first()[0]
