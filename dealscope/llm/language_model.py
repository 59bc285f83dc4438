"""Documents scored by a subword lattice whose weights are learned from the training documents.

``lattice_scores`` gives every document the probability of its words, all segmentations of each word summed.

* A novel word is a path through the lattice of an existing vocabulary's pieces (see ``lattice``). The vocabulary's scores
  number its merges, 0 being the first; by Zipf's law they weight the pieces before anything is learned. Rounds
  of expected counts over all distinct training words, found by forward and backward recursion in log space, then
  move the weights. The first piece of a word, the pieces after it and the end of the word are one choice each, so
  the weights of all words together do not exceed one.
* A word that occurs in training documents is one more path, from start to end: absolute discounting takes a part of each
  word's count, and what is taken is shared out over all words by their lattices.
* Documents come from classes (their language), each with discounted counts of its own on top of those of all
  documents. A document's probability is the sum over the classes, as a text does not name its own.

The words, their counts and the lattices' expected counts are gathered from all training documents. What reaches
the driver is bounded: sums, one number per piece, the classes, and up to HOT_WORDS of the most frequent words, which are
looked up where a text is read. All other words meet their values in a join, where none of them is frequent. Words are
told apart by 64-bit hashes there.

Rows: a null text is empty and scores the end of the text alone. A row without key is held out, as is any whose rule says so;
it is scored like all others. Repeated rows count and are scored each. Without training documents the weights are those of
the vocabulary. Columns of other names play no part and do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from dealscope.llm.lattice import Lattice, Trie, chunked, read_pieces
from dealscope.llm.text import Block, blocks
from dealscope.session import stage

VOCABULARY = "piece_bpe_32k.model"
HOT_WORDS = 200_000
#: The most frequent values of the class column form classes of their own, all other documents one more.
CLASSES = 5
ROUNDS = 2
#: Weight of the vocabulary's scores against learned counts, in words for each piece.
PRIOR_WORDS = 0.1
BLOCK_BYTES = 4 << 20
LOG10 = log(10)

#: Bytes of words: all but space, tab, line feed, vertical tab, form feed and carriage return.
_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def held_out_rule(key: str = "doc_id") -> Column:
    """True for one of ten documents, by the checksum of the key's text; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _words(texts: pa.Array) -> Iterator[tuple[int, Block, np.ndarray]]:
    """(first row, words, hash of each word) of blocks of the texts, A-Z lower-cased."""
    for first, part in blocks(texts, BLOCK_BYTES):
        block = Block(pc.ascii_lower(part), lower=False, is_word=_IS_WORD)
        yield first, block, block.word_hashes()


def _distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, ``of``, number) of each distinct pair."""
    if not len(hashes):
        return np.zeros(0, np.int64), of[:0], np.zeros(0, np.int64)
    order = np.lexsort((hashes, of))
    sorted_hashes, sorted_of = hashes[order], of[order]
    heads = np.flatnonzero(np.concatenate([[True], (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_of[1:] != sorted_of[:-1])]))
    return order[heads], sorted_of[heads], np.diff(np.append(heads, len(order)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, block, hashes in _words(batch.column("text")):
            at, of, number = _distinct(hashes, kind[first + block.row])
            data = pa.py_buffer(block.data.tobytes())
            starts, lengths = block.starts[at], block.ends[at] - block.starts[at]
            # The words one after the other, as one gather over the text's bytes.
            ends = np.concatenate([[0], np.cumsum(lengths)])
            places = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
            text = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                                         pa.py_buffer(np.frombuffer(data, np.uint8)[places].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), text.cast(pa.string()),
                                              pa.array(of.astype(np.int32)), pa.array(number)], ["hash", "word", "class", "n"])


class Pieces:
    """A vocabulary with the weights of its pieces: first ones, later ones, and the end of a word as a later one."""

    _known: dict[str, tuple[Trie, np.ndarray, np.ndarray]] = {}

    def __init__(self, vocabulary: str, expected: np.ndarray | None = None):
        if vocabulary not in self._known:
            pieces, scores = read_pieces(vocabulary)
            self._known[vocabulary] = (Trie(pieces), np.array([p[:1] == b" " for p in pieces]), scores)
        self.trie, is_first, scores = self._known[vocabulary]
        prior = 1.0 / (10.0 + np.argsort(np.argsort(-scores, kind="stable"), kind="stable"))
        # The last number is that of word ends.
        counts = PRIOR_WORDS * len(prior) * np.append(prior / prior.sum(), 0.5)
        if expected is not None:
            counts = counts + expected
        groups = np.append(is_first, False)
        log_weight = np.zeros(len(counts))
        for group in (groups, ~groups):
            log_weight[group] = np.log(counts[group] / counts[group].sum())
        self.log_weight, self.log_end = log_weight[:-1], log_weight[-1]

    def log_likelihood(self, words: pa.Array) -> np.ndarray:
        out = np.zeros(len(words))
        for rows, data, offsets in chunked(words):
            out[rows] = Lattice(self.trie, data, offsets).log_likelihood(self.log_weight)
        return out + self.log_end

    def expected(self, words: pa.Array) -> np.ndarray:
        """Expected number of each piece and of word ends, each word counted once."""
        found = np.zeros(len(self.log_weight) + 1)
        for rows, data, offsets in chunked(words):
            found[:-1] += Lattice(self.trie, data, offsets).expected(self.log_weight, np.ones(len(rows)))
        found[-1] = len(words)
        return found


def learn_pieces(words: DataFrame, vocabulary: str, rounds: int) -> np.ndarray | None:
    """Expected counts of the vocabulary's pieces over the distinct words of a column ``word``."""
    expected: np.ndarray | None = None
    for _ in range(rounds):
        def count(batches: Iterator[pa.RecordBatch], known=expected) -> Iterator[pa.RecordBatch]:
            pieces, total = Pieces(vocabulary, known), None
            for batch in batches:
                found = pieces.expected(batch.column(0))
                total = found if total is None else total + found
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "expected"])

        rows = words.select("word").mapInArrow(count, "piece bigint, expected double").groupBy("piece").agg(
            F.sum("expected").alias("expected")).toArrow()
        if not rows.num_rows:
            return expected
        found = np.zeros(len(Pieces(vocabulary).log_weight) + 1)
        found[rows.column("piece").to_numpy()] = rows.column("expected").to_numpy()
        expected = found
    return expected


def _class_index(docs: DataFrame, column: str | None, learn: Column, most: int) -> tuple[Column, list[int]]:
    """Class of a row from 0, and the training documents of each class."""
    if column is None:
        return F.lit(0), [docs.where(learn).count()]
    found = docs.where(learn).groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    top = found.where(F.col("class").isNotNull()).orderBy(F.desc("n"), "class").limit(most).collect()
    index = F.lit(len(top))
    for i, row in enumerate(top):
        index = F.when(F.col(column) == F.lit(row["class"]), F.lit(i)).otherwise(index)
    sizes = [row["n"] for row in top]
    return index, [*sizes, total - sum(sizes)]


def _hot_from(words: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach, up to a sixteenth of a power of two.

    Counts fall into some thousand steps, which are counted; no task sorts or merges the words themselves.
    """
    step = F.floor(F.log2("all") * 16)
    total, least = 0, 1
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("all").alias("least"),
                                                      F.max("all").alias("greatest")).orderBy(F.desc("step")).collect():
        total += row["n"]
        if total > most:
            return row["greatest"] + 1
        least = row["least"]
    return least


def lattice_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", class_column: str | None = "lang",
                   held_out: Column | None = None, vocabulary: str = VOCABULARY, rounds: int = ROUNDS,
                   classes: int = CLASSES, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score; logarithms to the base 10.

    ``base_score`` is that of whole words with 0.1 added to each count; the end of a text is a token there.
    """
    held = F.coalesce(held_out if held_out is not None else held_out_rule(key), F.lit(True))
    index, sizes = _class_index(docs, class_column, ~held, classes)
    use = [k for k, size in enumerate(sizes) if size] or [0]
    trained = sum(sizes)

    read = docs.select(F.when(held, F.lit(-1)).otherwise(index).cast("int").alias("class"), F.col(text).alias("text"))
    counted = read.mapInArrow(_count_words, "hash bigint, word string, class int, n bigint")
    counts = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(F.lit(0))).alias(f"c{k}") for k in use]
    words = stage(counted.groupBy("hash", "word").agg(F.sum("n").alias("all"), *counts), "words")
    count = sum((F.col(f"c{k}") for k in use), F.lit(0))
    totals = words.agg(
        *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"words{k}") for k in use],
        *[F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"kinds{k}") for k in use],
        F.count(F.when(count > 0, 1)).alias("kinds"), F.count(F.when(count == 1, 1)).alias("once"),
        F.count(F.when(count == 2, 1)).alias("twice")).first()
    size = sum(totals[f"words{k}"] for k in use)
    tokens, kinds = size + trained, totals["kinds"] + (trained > 0)
    base = base_rule(tokens, kinds)
    discount = min(0.95, max(0.05, totals["once"] / max(1, totals["once"] + 2 * totals["twice"]))) if totals["once"] else 0.5

    expected = learn_pieces(words.where(count > 0), vocabulary, rounds)
    ends = [(sizes[k] + 0.5) / (totals[f"words{k}"] + sizes[k] + 1) for k in use]
    own = [(totals[f"words{k}"], totals[f"kinds{k}"]) for k in use]

    def share(n: np.ndarray, of: int, kinds: int, novel: np.ndarray) -> np.ndarray:
        """Log of discounted counts and their rest, shared out by ``novel``, all in logs."""
        if not of:
            return novel
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(n - discount, 0) / of), np.log(discount * kinds / of) + novel)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary, expected)
        for batch in batches:
            parts = [batch.column(f"c{k}").to_numpy() for k in use]
            total = sum(parts)
            novel = share(total, size, totals["kinds"], pieces.log_likelihood(batch.column("word")))
            values = [(share(part, *own[i], novel) + np.log1p(-ends[i])) / LOG10 for i, part in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("all"), pa.array(total), *map(pa.array, values)],
                                             ["hash", "all", "count", *[f"s{k}" for k in use]])

    sums = [f"s{k}" for k in use]
    scored = stage(words.mapInArrow(score_words, "hash bigint, `all` bigint, `count` bigint, "
                                    + ", ".join(f"{name} double" for name in sums)), "scored-words")
    least = _hot_from(scored, hot_words)
    known = scored.where(F.col("all") >= least).toArrow().sort_by("hash")
    table = docs.sparkSession.sparkContext.broadcast(
        (known["hash"].to_numpy(), known["count"].to_numpy(), [known[name].to_numpy() for name in sums]))

    def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, values = table.value
        base_value = base_of(number, tokens, kinds)
        for batch in batches:
            for first, block, found in _words(batch.column("text")):
                at, row, n = _distinct(found, block.row)
                found = found[at].view(np.int64)
                place = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                is_hot = hashes[place] == found if len(hashes) else np.zeros(len(found), bool)
                hot_row, hot_n, place = row[is_hot], n[is_hot], place[is_hot]

                def summed(of: np.ndarray) -> pa.Array:
                    return pa.array(np.bincount(hot_row, hot_n * of[place], block.rows).astype(float))

                rest = np.concatenate([[0], np.cumsum(np.bincount(row[~is_hot], minlength=block.rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name).slice(first, block.rows) for name in ("key", "held_out")], pa.array(block.counts),
                     summed((number > 0) * 1.0).cast(pa.int64()), summed(base_value), *map(summed, values),
                     pa.ListArray.from_arrays(pa.array(rest), pa.array(found[~is_hot])),
                     pa.ListArray.from_arrays(pa.array(rest), pa.array(n[~is_hot]))],
                    ["key", "held_out", "n", "known", "base", *sums, "hashes", "numbers"])

    kind = docs.schema[key].dataType.simpleString()
    first = docs.select(F.col(key).alias("key"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(
        read_documents, f"key {kind}, held_out boolean, n bigint, known bigint, base double, "
        + ", ".join(f"{name} double" for name in sums) + ", hashes array<bigint>, numbers array<bigint>")
    found = stage(first.withColumn("row", F.monotonically_increasing_id()), "hot-scores")

    pairs = found.select("row", F.explode(F.arrays_zip("hashes", "numbers")).alias("pair")).select(
        "row", F.col("pair.hashes").alias("hash"), F.col("pair.numbers").alias("n"))
    met = pairs.join(scored.where(F.col("all") < least).drop("all"), "hash").groupBy("row").agg(
        F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(F.lit(0))).alias("cold_known"),
        F.sum(F.col("n") * base(F.col("count"))).alias("cold_base"),
        *[F.sum(F.col("n") * F.col(name)).alias(f"cold_{name}") for name in sums])

    def both(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"cold_{name}"), F.lit(0))

    by_class = [both(name) + F.lit(log(ends[i]) / LOG10 + log((sizes[k] + 0.5) / (trained + 0.5 * len(use))) / LOG10)
                for i, (k, name) in enumerate(zip(use, sums))]
    most = F.greatest(*by_class) if len(by_class) > 1 else by_class[0]
    summed = sum((F.pow(F.lit(10.0), value - most) for value in by_class), F.lit(0.0))
    return found.drop("hashes", "numbers").join(met, "row", "left").select(
        F.col("key").alias(key), "held_out", (F.col("n") + 1).alias("n_tokens"),
        (both("known") + F.lit(int(trained > 0))).cast("bigint").alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (both("base") + base(F.lit(trained))).alias("base_score"), (most + F.log10(summed)).alias("score"))


def base_rule(tokens: int, kinds: int):
    """Log of an added-0.1 share, as a column."""
    return lambda count: F.log10((count + F.lit(0.1)) / F.lit(tokens + 0.1 * (kinds + 1)))


def base_of(count: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    return np.log10((count + 0.1) / (tokens + 0.1 * (kinds + 1)))
