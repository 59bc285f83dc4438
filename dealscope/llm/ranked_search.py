"""Exact top documents per query by range-maximum search in posting lists.

Texts are read once. Only terms that occur in the queries are kept: per document their numbers and frequencies, stored with
its length. Lengths and document frequencies over all documents then fix every impact, an integer.

A task takes stored documents in order of their identifier, some SHARD_POSTINGS postings at a time. Each term's postings
lie in order of the documents, with a sparse table above them: level j holds the place of the largest impact among 2^j
neighbours, so the largest of any range of a list is the better of two entries. For a query, an interval of documents is
bounded by the sum of its terms' largest impacts inside. The interval of the highest bound goes first: its document of the largest single
impact is scored, and what is left and right of it becomes two intervals with bounds of their own. An interval of few
postings is scored whole. The search ends where no bound reaches the worst of the best documents so far, which a task
carries from one shard to the next; equal bounds are followed up, as ties go to the smaller identifier. The tasks' best documents are
ranked by a window whose groups are cut before they are sent.

Rows: a null text has no terms. A document without terms counts in nothing and is no result. A document without identifier counts and is ranked
after those of equal score that have one, its identifier null. Repeated rows count and are ranked each. Of several queries with one identifier
the smallest text counts; a query without terms, or whose terms occur nowhere, has no rows. Columns of other names play no part.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from dealscope.llm.text import Block, blocks
from dealscope.session import stage

TOP = 20
#: Queries are searched for in rounds of about so many characters; each round reads the documents once.
ROUND_CHARS = 4 << 20
#: Postings searched at a time; their sparse tables take some 4 bytes for each and level.
SHARD_POSTINGS = 1 << 20
#: An interval with no more postings of the query than this is scored whole.
SMALL = 4096
BLOCK_BYTES = 4 << 20
_NO_ID = np.iinfo(np.int64).max

#: Bytes of terms: digits, ASCII letters and all bytes of other characters.
_IS_TERM = np.zeros(256, np.uint8)
_IS_TERM[0x30:0x3A] = _IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = 1


def weight_of(documents: int, holding: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


def _terms(texts: pa.Array) -> Iterator[tuple[int, Block, np.ndarray]]:
    for first, part in blocks(texts, BLOCK_BYTES):
        block = Block(pc.ascii_lower(part), lower=False, is_word=_IS_TERM)
        yield first, block, block.word_hashes()


class Queries:
    """The distinct terms of some queries by their hashes, and for each query its terms with their repeats."""

    def __init__(self, texts: Sequence[str]):
        counted: list[Counter] = [Counter() for _ in texts]
        for first, block, hashes in _terms(pa.array(texts, pa.large_string())):
            for row, value in zip((first + block.row).tolist(), hashes.tolist()):
                counted[row][value] += 1
        self.hashes = np.array(sorted(set().union(*counted)), np.uint64)
        self.terms, self.repeats = [], []
        for own in counted:
            self.terms.append(np.searchsorted(self.hashes, np.array(sorted(own), np.uint64)))
            self.repeats.append(np.array([own[value] for value in sorted(own)], np.int64))

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Key, number of terms, and the query terms with their frequencies, per document."""
        for batch in batches:
            for first, block, hashes in _terms(batch.column("text")):
                place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
                met = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
                pairs, counts = np.unique(block.row[met] * np.int64(max(1, len(self.hashes))) + place[met], return_counts=True)
                row, term = np.divmod(pairs, np.int64(max(1, len(self.hashes))))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.rows))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(first, block.rows), pa.array(block.counts),
                     pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))], ["key", "n", "terms", "tf"])


class Postings:
    """Posting lists over some documents, in order of their identifiers, with their sparse tables of range maxima."""

    def __init__(self, keys: np.ndarray, document: np.ndarray, term: np.ndarray, part: np.ndarray, terms: int):
        """``part`` is the impact of each posting before its term's weight."""
        order = np.argsort(keys, kind="stable")
        self.keys, self.documents = keys[order], len(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place = term.astype(np.int64) * self.documents + rank[document]
        order = np.argsort(self.place, kind="stable")
        self.place, self.part = self.place[order], part[order]
        sizes = np.bincount(term, minlength=terms)
        self.ends = np.cumsum(sizes)
        self.levels = [np.arange(len(self.part), dtype=np.int32)]
        span = 1
        while 2 * span <= sizes.max(initial=0):
            left, right = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(self.part[right] > self.part[left], right, left))
            span *= 2

    def ranges(self, terms: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists' postings of the documents from ``low`` to before ``high`` begin and end."""
        at = np.searchsorted(self.place, np.concatenate([terms * self.documents + low, terms * self.documents + high]))
        return at[:len(terms)], at[len(terms):]

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each range; none may be empty."""
        level = np.frexp(end - begin)[1] - 1
        first, second = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
        for j in np.unique(level).tolist():
            at = level == j
            first[at], second[at] = self.levels[j][begin[at]], self.levels[j][end[at] - (1 << j)]
        return np.where(self.part[second] > self.part[first], second, first)

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int, best: list[tuple[int, int]]) -> None:
        """Put the highest (score, -key) of these documents into the heap ``best``."""
        kept = weights > 0
        terms, weights = terms[kept].astype(np.int64), weights[kept]
        waiting: list[tuple] = []

        def offer(score: int, document: int) -> None:
            if score > 0:
                own = (score, -int(self.keys[document]))
                if len(best) < top:
                    heapq.heappush(best, own)
                elif own > best[0]:
                    heapq.heapreplace(best, own)

        def wait(low: int, high: int, lists: np.ndarray, values: np.ndarray) -> None:
            """Bound the interval by the lists that have postings in it."""
            begin, end = self.ranges(lists, low, high)
            some = end > begin
            if some.any():
                begin, end, lists, values = begin[some], end[some], lists[some], values[some]
                most = self.maxima(begin, end)
                impacts = values * self.part[most]
                heapq.heappush(waiting, (-int(impacts.sum()), low, high, int(most[impacts.argmax()]), begin, end, lists, values))

        wait(0, self.documents, terms, weights)
        while waiting:
            bound, low, high, most, begin, end, lists, values = heapq.heappop(waiting)
            if len(best) == top and -bound < best[0][0]:
                return
            sizes = end - begin
            if sizes.sum() <= SMALL or high - low == 1:
                at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                own = np.repeat(lists * self.documents + low, sizes)
                # Whole numbers below 2^53 are added without error.
                score = np.zeros(high - low, np.int64)
                np.add.at(score, self.place[at] - own, np.repeat(values, sizes) * self.part[at])
                chosen = np.flatnonzero(score > 0 if len(best) < top else score >= best[0][0])
                if len(chosen) > top:
                    chosen = chosen[np.lexsort((chosen, -score[chosen]))[:top]]
                for document in chosen.tolist():
                    offer(int(score[document]), low + document)
                continue
            document = int(self.place[most] % self.documents)
            at = np.minimum(np.searchsorted(self.place, lists * self.documents + document), len(self.place) - 1)
            met = self.place[at] == lists * self.documents + document
            offer(int((values[met] * self.part[at[met]]).sum()), document)
            wait(low, document, lists, values)
            wait(document + 1, high, lists, values)


def _search(found: DataFrame, queries: Queries, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    """The best documents of each task for each query, by the query's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.terms]
        held: list[tuple] = []
        size = 0

        def search() -> None:
            nonlocal held, size
            if size:
                keys, counts, lengths, term, tf = map(np.concatenate, zip(*held))
                m = 75 + (25 * lengths * documents) // terms
                part = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, counts))
                lists = Postings(keys, np.repeat(np.arange(len(keys)), counts), term, part, len(weights))
                for own, repeats, heap in zip(queries.terms, queries.repeats, best):
                    lists.search(own, weights[own] * repeats, top, heap)
            held, size = [], 0

        for batch in batches:
            keys = pc.fill_null(batch.column("key"), int(_NO_ID)).to_numpy()
            offsets = batch.column("terms").offsets.to_numpy().astype(np.int64)
            term, tf = batch.column("terms").values.to_numpy(), batch.column("tf").values.to_numpy()
            lengths = batch.column("n").to_numpy()
            low = 0
            while low < len(keys):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SHARD_POSTINGS - size, "right")) - 1)
                high = min(high, len(keys))
                part = slice(offsets[low], offsets[high])
                held.append((keys[low:high], np.diff(offsets[low:high + 1]), lengths[low:high], term[part], tf[part]))
                size += int(offsets[high] - offsets[low])
                low = high
                if size >= SHARD_POSTINGS or low < len(keys):
                    search()
        search()
        rows = [(query, score, -key) for query, heap in enumerate(best) for score, key in heap]
        if rows:
            query, score, key = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(score, pa.int64()), pa.array(key, pa.int64())],
                                             ["query", "score", "key"])

    return found.where(F.size("terms") > 0).select("key", "n", "terms", "tf").mapInArrow(run, "query int, score bigint, key bigint")


def ranked_documents(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text",
                     top: int = TOP) -> DataFrame:
    """One row per query and found document: query key, rank from 1, key, score."""
    spark = docs.sparkSession
    asked = stage(queries.groupBy(F.col(query_key).alias("query")).agg(F.min(text).alias("text")).where("text is not null"), "queries")
    rounds = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // ROUND_CHARS
    number = F.pmod(F.xxhash64("query", "text"), F.lit(rounds))
    results = []
    for part in range(rounds):
        rows = asked.where(number == part).orderBy("query").collect()
        if rows:
            kind = queries.schema[query_key].dataType.simpleString()
            results.append(_one_round(docs, [r["text"] for r in rows], [r["query"] for r in rows], kind, key, text, top)
                           .select(F.col("query").alias(query_key), "rank", F.col("key").alias(key), "score"))
    if not results:
        kinds = [queries.schema[query_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()]
        return spark.createDataFrame([], f"`{query_key}` {kinds[0]}, rank int, `{key}` {kinds[1]}, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _one_round(docs: DataFrame, texts: list[str], ids: list, kind: str, key: str, text: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    asked = Queries(texts)
    found = stage(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(
        asked.read, "key bigint, n bigint, terms array<int>, tf array<bigint>").where("n > 0"), "postings")
    totals = found.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    weights = np.zeros(max(1, len(asked.hashes)), np.int64)
    for row in holding:
        weights[row["term"]] = weight_of(totals["documents"], row["df"])
    best = _search(found, asked, weights, totals["documents"], max(1, totals["terms"]), top)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    id_type = docs.schema[key].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(ids)), f"number int, id {kind}")
    return ranked.join(F.broadcast(names), F.col("query") == F.col("number")).select(
        F.col("id").alias("query"), "rank", F.when(F.col("key") != int(_NO_ID), F.col("key")).cast(id_type).alias("key"), "score")
