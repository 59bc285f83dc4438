"""Similarity join on word shingles by a MinHash LSH forest, with exact verification.

A tree gives each text a label of ``DEPTH`` minimum hashes; texts with the same prefix are grouped by its hash. The
shortest prefix is the longest with which a pair at the threshold shares one in some tree with the target recall, the
same for all texts. All depths from whole labels to that one are proposed in one pass. Texts with a common prefix are
compared with a leader of their group, the one that meets most others, and not with each other, so these pairs stay
linear in the rows.

At the last depth, texts that are not yet in their leader's class are compared further, in rounds with more and more
of them as leaders, with the members of their group that are in another class and could still be similar: shingles
that no other candidate has cannot match, so they bound the similarity of a text from above. The rounds end when
no such text is left; no pair that shares a prefix is given up.

Links connect texts of one class only, so they are counted once the classes are settled: the texts of a class are
dealt into blocks, each two blocks are compared in a task, and only counts per text leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dealscope.llm.components import components
from dealscope.llm.tables import identity, join_hot, maybe_among, only, text_or_empty
from dealscope.llm.text import blocks, hash_family, mix, shingle_sets
from dealscope.session import stage

THRESHOLD = 0.8
TREES = 24
DEPTH = 8
TARGET_RECALL = 0.999

#: Shingles in a block of a class whose links are counted, and columns of the matrices they are counted with.
BLOCK_SHINGLES = 1 << 17
COLUMNS = 1 << 12

_CLOSE = 1e-9
_MULTIPLIERS = hash_family(TREES * DEPTH, 3)


def recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair at the threshold shares a prefix of this depth in some tree."""
    return 1 - (1 - threshold ** depth) ** trees


def last_depth(threshold: float, target: float) -> int:
    return next((d for d in range(DEPTH, 1, -1) if recall(threshold, d) >= target), 1)


def _labels(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One byte per tree and level for each text: the low bits of a mixed minimum hash."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, TREES * DEPTH), np.uint8)
    if len(filled):
        starts = offsets[:-1][filled]
        for j, multiplier in enumerate(_MULTIPLIERS):
            out[filled, j] = mix(np.minimum.reduceat(hashes * multiplier, starts)).astype(np.uint8)
    return out


def _nodes(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes that stand for each set of shingles; zeros for the empty set."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    if len(filled):
        starts = offsets[:-1][filled]
        out[filled, 0] = np.add.reduceat(mix(hashes), starts)
        out[filled, 1] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(1)), starts)
    return [row.tobytes() for row in out]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in blocks(batch.column("text")):
            hashes, offsets = shingle_sets(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(part)), batch.column("content").slice(first, len(part)),
                 pa.array(_nodes(hashes, offsets), pa.binary()),
                 pa.array([row.tobytes() for row in _labels(hashes, offsets)], pa.binary())],
                names=["doc_id", "content", "node", "labels"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part in blocks(batch.column("text")):
            hashes, offsets = shingle_sets(part)
            sets = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, offsets), pa.binary()), pa.array(sets, pa.binary())],
                                             names=["node", "shingles"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for one, other in zip(batch.column("one"), batch.column("other")):
            one, other = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
            both = len(np.intersect1d(one, other, assume_unique=True))
            found.append(1 - both / (len(one) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())],
                                         names=["a", "b", "distance"])


def content_hash(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for owner, shingles in zip(batch.column("owner"), batch.column("shingles")):
            values = np.frombuffer(shingles.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.full(len(values), owner.as_py()))],
                                             names=["shingle", "owner"])


class Forest:
    """The texts that share a prefix with another one, and the distances found so far."""

    def __init__(self, docs: DataFrame, text: str, sketches: DataFrame, threshold: float, target: float):
        self.threshold = threshold
        self.reach = 1 - threshold + _CLOSE
        self.depth = last_depth(threshold, target)
        nodes = (sketches.where(F.col("node") != F.lit(bytes(16)))
                 .groupBy("node").agg(F.min(F.struct("_none", "_key", "content")).alias("first"), F.first("labels").alias("labels")))
        trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: F.struct(
            tree.alias("tree"), F.substring("labels", tree * DEPTH + 1, F.lit(DEPTH)).alias("label"))))
        placed = (nodes.select("node", "first", trees.alias("_t")).select("node", "first", "_t.tree", "_t.label")
                  .withColumn("group", self._group(self.depth)))
        shared = placed.groupBy("group").agg(F.count("*").alias("met")).where("met > 1")
        members = stage(placed.join(shared, "group").select("group", "tree", "label", "node", "first", "met"), "members")
        names = ["_none", "_key", "_content"]
        wanted = stage(members.select(F.col("first.*")).withColumnRenamed("content", "_content").distinct(), "wanted")
        marked = docs.withColumns(identity("doc_id", content_hash(text)))
        # An inner join (``wanted`` has no repeats), as the optimizer would move a semi join before the filter.
        texts = maybe_among(marked, wanted, names).join(wanted, names).select(F.col(text).cast("string").alias("text"))
        self.sets = stage(texts.mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"]), "sets")
        info = self._info(members)
        # Texts with too many shingles of their own are like nothing else.
        self.members = stage(members.join(info, "node").where(F.col("common") >= threshold * F.col("size") - _CLOSE)
                             .select("group", "tree", "label", "node", "size", "common", "weight"), "members")
        self.found = None
        # From whole labels to the last depth; pairs that several depths propose are measured once.
        stars = [self._star(self.members.withColumn("group", self._group(depth))) for depth in range(DEPTH, self.depth - 1, -1)]
        self.measure(reduce(DataFrame.unionByName, stars))
        self._finish()

    @staticmethod
    def _group(depth: int) -> Column:
        return F.xxhash64("tree", F.substring("label", 1, depth))

    def _info(self, members: DataFrame) -> DataFrame:
        """(node, size, common, weight): shingles, those that another candidate has too, and candidates met in all trees."""
        sizes = self.sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("size"), F.xxhash64("node").alias("owner"))
        rows = self.sets.select(F.xxhash64("node").alias("owner"), "shingles").mapInArrow(_shingle_rows, "shingle long, owner long")
        single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).where("n = 1")
        own = single.groupBy("owner").agg(F.count("*").alias("own"))
        weights = members.groupBy("node").agg(F.sum("met").alias("weight"))
        return (sizes.join(own, "owner", "left").join(weights, "node")
                .select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"), "weight"))

    def _possible(self) -> Column:
        """Whether member and leader could be similar, by what they have in common with any text."""
        share = self.threshold / (1 + self.threshold)
        return F.least("common", "lead.common") >= share * (F.col("size") + F.col("lead.size")) - _CLOSE

    def _star(self, members: DataFrame) -> DataFrame:
        leaders = members.groupBy("group").agg(F.max_by(F.struct("node", "size", "common"), F.struct("weight", "node")).alias("lead"))
        pairs = members.join(leaders, "group").where((F.col("node") != F.col("lead.node")) & self._possible())
        return pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))

    def measure(self, pairs: DataFrame) -> DataFrame:
        """Exact distances of the pairs that are new; they are kept as well."""
        new = pairs.distinct()
        if self.found is not None:
            new = new.join(self.found, ["a", "b"], "left_anti")
        one = self.sets.withColumnsRenamed({"node": "a", "shingles": "one"})
        other = self.sets.withColumnsRenamed({"node": "b", "shingles": "other"})
        measured = stage(new.join(other, "b").join(one, "a").select("a", "b", "one", "other")
                         .mapInArrow(_distances, "a binary, b binary, distance double"), "distances")
        self.found = measured if self.found is None else self.found.unionByName(measured)
        return measured

    def _beside_hub(self, members: DataFrame) -> DataFrame:
        """``members`` with ``inside``: shingles shared with the member of the group that meets most others, where known."""
        hubs = members.groupBy("group").agg(F.max_by(F.struct("node", "size"), F.struct("weight", "node")).alias("_hub"))
        rows = members.join(hubs, "group").withColumns({"a": F.least("node", "_hub.node"), "b": F.greatest("node", "_hub.node")})
        alike = 1 - F.col("distance")
        inside = F.when(F.col("a") == F.col("b"), F.col("size")).otherwise(
            F.round(alike / (1 + alike) * (F.col("size") + F.col("_hub.size"))))
        return rows.join(self.found, ["a", "b"], "left").withColumn("inside", inside).select(*members.columns, "inside")

    def _still_possible(self) -> Column:
        """As ``_possible``; what both share with the hub and what both have beside it bound their overlap apart."""
        share = self.threshold / (1 + self.threshold)
        most = (F.least("inside", "lead.inside")
                + F.least(F.col("common") - F.col("inside"), F.col("lead.common") - F.col("lead.inside")))
        near = most >= share * (F.col("size") + F.col("lead.size")) - _CLOSE
        return self._possible() & F.coalesce(near, F.lit(True))

    def _finish(self) -> None:
        """Compares, at the last depth, what the leaders have left in classes of their own."""
        members = stage(self._beside_hub(self.members.select("group", "node", "size", "common", "weight")), "members")
        self.roots, count = components(self.links(self.found)), 16
        while True:
            roots = self.roots
            current = stage(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "open")
            main = current.groupBy("group").agg(F.max_by("root", F.struct("weight", "node")).alias("main"),
                                                F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high")
            current = current.join(main.select("group", "main"), "group")
            apart = current.where(F.col("root") != F.col("main"))
            part = F.pmod(F.xxhash64("node"), F.lit(count))
            leaders = stage(apart.groupBy("group", part.alias("_part")).agg(
                F.max_by(F.struct("node", "size", "common", "inside", "root"), F.struct("weight", "node")).alias("lead"))
                .drop("_part"), "leaders")
            if leaders.isEmpty():
                return
            pairs = current.join(leaders, "group").where((F.col("root") != F.col("lead.root")) & self._still_possible())
            new = self.measure(pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")))
            self._unite(self.links(new))
            # What has been compared with all that it could be linked to in its group is done there.
            done = leaders.select("group", F.col("lead.node").alias("node"))
            members = current.drop("root", "main").join(done, ["group", "node"], "left_anti")
            count *= 32

    def links(self, measured: DataFrame) -> DataFrame:
        return measured.where(F.col("distance") <= self.reach).select("a", "b")

    def _unite(self, links: DataFrame) -> None:
        """Classes with the new links: only what they change among the roots is worked out."""
        def root(of: str) -> DataFrame:
            return self.roots.select(F.col("node").alias(of), F.col("root").alias(f"_{of}"))

        ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
        between = stage(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
                        .where("a != b").distinct(), "between")
        if between.isEmpty():
            return
        higher = components(between).select(F.col("node").alias("root"), F.col("root").alias("_higher"))
        # Nodes without links so far are roots of their own.
        known = self.roots.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                                       .join(self.roots, "node", "left_anti").withColumn("root", F.col("node")))
        self.roots = stage(known.join(higher, "root", "left")
                           .select("node", F.least("root", F.coalesce("_higher", "root")).alias("root")), "roots")


def _overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of each set of ``one`` with each of ``other``."""
    left, right = np.concatenate(one), np.concatenate(other)
    common = np.intersect1d(left, right)
    out = np.zeros((len(one), len(other)), np.float64)
    sides = []
    for values, sets in ((left, one), (right, other)):
        column = np.searchsorted(common, values)
        known = np.zeros(len(values), bool)
        inside = column < len(common)
        known[inside] = common[column[inside]] == values[inside]
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known]
        column = column[known]
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order], len(sets)))
    for first in range(0, len(common), COLUMNS):
        parts = []
        for row, column, rows in sides:
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            part = np.zeros((rows, min(COLUMNS, len(common) - first)), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _block_links(threshold: float):
    """Links of each text of two blocks of a class, or within one block, in the other."""
    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        nodes, part = table.column("node").combine_chunks(), table.column("part").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets], np.float64)
        counts = np.zeros(len(sets), np.int64)
        one, other = np.flatnonzero(part == low), np.flatnonzero(part == high)
        if len(one) and len(other):
            both = _overlaps([sets[i] for i in one], [sets[i] for i in other])
            linked = both >= (threshold - _CLOSE) * (sizes[one][:, None] + sizes[other][None, :] - both)
            if low == high:
                np.fill_diagonal(linked, False)
                counts[one] = linked.sum(axis=1)
            else:
                counts[one], counts[other] = linked.sum(axis=1), linked.sum(axis=0)
        some = np.flatnonzero(counts)
        return pa.table({"node": nodes.take(pa.array(some)), "links": pa.array(counts[some])})
    return run


def count_links(sets: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): for each text of a class, the texts of the class that are similar to it."""
    sized = sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("size")).join(roots, "node")
    classes = stage(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
                    .select("root", "n", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("parts")), "classes")
    # Two texts in a class are linked to each other.
    two = roots.join(classes.where("n = 2"), "root", "left_semi").select("node", F.lit(1).cast("long").alias("n_links"))
    placed = (roots.join(classes.where("n > 2"), "root")
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("node", "root", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high")))
    counted = (placed.join(sets, "node").groupBy("root", "low", "high")
               .applyInArrow(_block_links(threshold), "node binary, links long"))
    return two.unionByName(counted.groupBy("node").agg(F.sum("links").alias("n_links")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL,
                    key: str = "doc_id", text: str = "text", links: bool = True) -> DataFrame:
    """One row per document: key, class_id, n_links, copies, class_root, content.

    Texts are linked when the Jaccard similarity of their sets of five-word shingles is at least ``threshold``; texts with
    the same set are one node of the join. A class is a connected component of links; class_id is its smallest key (null
    keys are passed over; null only if all are null), n_links counts all links between the document's shingle set and
    other sets of its class (null unless ``links``), copies the documents with its set, class_root tells classes apart even without keys, content is a hash of the text that tells rows with one key
    apart. Texts of fewer than five words are one shingle; texts without words (and null) are alike. Repeated
    rows get equal rows. Other columns are ignored; an empty table gives an empty table.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    sketches = stage(plain.select("doc_id", F.col(text).alias("text"), content_hash(text).alias("content"))
                     .mapInArrow(_sketch, "doc_id long, content long, node binary, labels binary"), "sketches")
    rows = sketches.withColumns({"_none": F.col("doc_id").isNull(), "_key": F.coalesce("doc_id", F.lit(0))})
    forest = Forest(plain, text, rows, threshold, target_recall)
    roots = forest.roots
    nodes = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("smallest"))
    known = nodes.join(roots, "node", "left")
    if links:
        known = known.join(count_links(forest.sets, roots, threshold), "node", "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")) if links else F.lit(None).cast("long")
    known = stage(known.select("node", "copies", "smallest", F.coalesce("root", "node").alias("root"), n_links.alias("n_links")), "nodes")
    classes = known.groupBy("root").agg(F.min("smallest").alias("class_id"), F.count("*").alias("_sets"))
    per_node = stage(join_hot(known, classes, ["root"], "_sets", known.count())
                     .select("node", "root", "class_id", "n_links", "copies"), "classes")
    return join_hot(rows.select("doc_id", "content", "node"), per_node, ["node"], "copies", rows.count()).select(
        F.col("doc_id").alias(key), "class_id", "n_links", "copies", F.hex("root").alias("class_root"), "content")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest key (null keys last, then by a hash of the text)."""
    classes = near_duplicates(docs, threshold, key=key, text=text, links=False)
    first = F.min(F.struct(F.col(key).isNull().alias("_none"), F.coalesce(F.col(key), F.lit(0)).alias("_key"),
                           F.col("content").alias("_content")))
    stay = classes.groupBy("class_root").agg(first.alias("_first")).select("_first.*")
    return only(docs, stay, key, content_hash(text))
