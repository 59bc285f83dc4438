"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; each model sees the words of the text and the log-odds of the
categories before it. So that a model does not learn to trust fitted values, those log-odds are out-of-fold
predictions while it is trained. Training uses a bounded sample of labelled documents and scoring covers every whole text.

A text's features are its distinct words and their beginnings of ``STEMS`` bytes, as 64-bit hashes; words are runs of
letters and digits or runs of other signs, in lower case. What a word says doesn't fade in a long text, as features
are present or not and only telling ones get a weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dealscope.llm.tables import text_or_empty
from dealscope.llm.text import Block, blocks, distinct_sorted

#: The chain over the labels given with the documents: names of 0/1 columns, in order.
CHAIN = ("low_quality", "toxic", "toxic_low_quality")
#: Upper bound of the labelled documents that are used for training.
SAMPLE_ROWS = 4000
FOLDS = 3
FEATURES = 600
PENALTY = 0.2
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.4

_KIND = np.zeros(256, np.uint8)
_KIND[33:] = 2
for _first, _last in ((48, 57), (97, 122), (128, 255)):
    _KIND[_first:_last + 1] = 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature hashes of each text: (hashes, offsets of the rows)."""
    block = Block(texts, is_word=_KIND)
    sizes = block.ends - block.starts
    found, rows = [block.word_hashes()], [block.row]
    for stem in STEMS:
        longer = sizes > stem
        starts = block.starts[longer]
        # A beginning is not the word of the same letters.
        found.append(block.span_hashes(starts, starts + stem) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        rows.append(block.row[longer])
    return distinct_sorted(np.concatenate(found), np.concatenate(rows), block.rows)


@dataclass
class Linear:
    """Weights of feature hashes, in hash order, and of the log-odds of earlier categories."""

    hashes: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    intercept: float

    def log_odds(self, hashes: np.ndarray, offsets: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.intercept) + earlier @ self.chained
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = np.flatnonzero(self.hashes[at] == hashes)
            row = np.searchsorted(offsets, known, "right") - 1
            total += np.bincount(row, self.weights[at[known]], minlength=len(total))
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scores(present: np.ndarray, positive: np.ndarray, rows: int, hits: int) -> np.ndarray:
    """Likelihood ratio of each feature with the category, for choosing features."""
    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0)

    rate = hits / rows
    absent, absent_positive = rows - present, hits - positive
    return (part(positive, present * rate) + part(present - positive, present * (1 - rate))
            + part(absent_positive, absent * rate) + part(absent - absent_positive, absent * (1 - rate)))


def fit_linear(row: np.ndarray, column: np.ndarray, hashes: np.ndarray, earlier: np.ndarray, y: np.ndarray,
               limit: int = FEATURES, penalty: float = PENALTY) -> Linear:
    """Logistic regression with a squared penalty on weights, by Newton steps.

    (row, column) are the features present; ``earlier`` has a column per category before. Of the features, those are used
    whose likelihood ratio with the label beats what the best of so many would reach by chance, at most ``limit`` of
    them. A constant label gives a constant.
    """
    rows, hits = len(y), int(y.sum())
    if not 0 < hits < rows:
        return Linear(hashes[:0], np.zeros(0), np.zeros(earlier.shape[1]), 6.0 if hits else -6.0)
    present = np.bincount(column, minlength=len(hashes))
    positive = np.bincount(column, y[row], minlength=len(hashes))
    gain = np.where(present >= 3, _scores(present, positive, rows, hits), 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:limit])
    best = best[gain[best] > np.log(max(len(hashes), 2))]
    place = np.full(len(hashes), -1)
    place[best] = np.arange(len(best))
    use = place[column] >= 0
    width = len(best)
    # At least 1: log-odds that hardly differ say little, and must not be blown up.
    scale = np.maximum(earlier.std(axis=0), 1.0)
    x = np.zeros((rows, width + earlier.shape[1] + 1), np.float32)
    x[row[use], place[column[use]]] = 1
    x[:, width:-1] = earlier / scale
    x[:, -1] = 1
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        chance = _sigmoid(x @ w)
        gradient = x.T @ (chance - y) + ridge * w
        weighted = x * np.sqrt(np.maximum(chance * (1 - chance), 1e-4))[:, None].astype(np.float32)
        change = np.linalg.solve((weighted.T @ weighted).astype(np.float64) + np.diag(ridge), gradient)
        w = w - change
        if np.abs(change).max() < 1e-4:
            break
    return Linear(hashes[best], w[:width], w[width:-1] / scale, float(w[-1]))


@dataclass
class Chain:
    """One linear model per category, in order."""

    names: tuple[str, ...]
    models: list[Linear]

    def probabilities(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odds = np.zeros((len(offsets) - 1, 0))
        for model in self.models:
            odds = np.column_stack([odds, model.log_odds(hashes, offsets, odds)])
        return _sigmoid(odds)


def fit_chain(hashes: np.ndarray, offsets: np.ndarray, fold: np.ndarray, labels: np.ndarray,
              names: Sequence[str] = CHAIN, folds: int = FOLDS) -> Chain:
    """``labels`` has a 0/1 column per category; ``fold`` assigns each row to one of ``folds``."""
    rows = len(fold)
    words, column = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    frequent = np.bincount(column, minlength=len(words)) >= 3
    use = frequent[column]
    row, column = row[use], column[use]
    place = np.cumsum(frequent) - 1
    words, column = words[frequent], place[column]
    earlier = np.zeros((rows, 0))
    models = []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        models.append(fit_linear(row, column, words, earlier, y))
        outside = np.zeros(rows)
        for out in range(folds):
            held = fold == out
            inside = np.flatnonzero(~held)
            if not held.any() or not len(inside):
                continue
            number = np.cumsum(~held) - 1
            part = ~held[row]
            model = fit_linear(number[row[part]], column[part], words, earlier[inside], y[inside])
            outside[held] = model.log_odds(words[column], np.searchsorted(row, np.arange(rows + 1)), earlier)[held]
        earlier = np.column_stack([earlier, outside])
    return Chain(tuple(names), models)


def label_columns() -> dict[str, Column]:
    """The categories of ``CHAIN`` from the label table; a missing label counts as 0."""
    low = (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int")
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low * toxic}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> Chain:
    """The chain fitted on at most ``rows`` labelled documents.

    The sample is the labelled keys that come first by a hash, so it doesn't depend on the layout of the tables. Labels
    with a null key or for missing documents are passed over; of several labels for a key, and of several documents
    with one, each is used. Without labels every document gets the same small probability.
    """
    given = (labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_key"),
             *[c.alias(name) for name, c in label_columns().items()]))
    # At most ``rows`` rows with four numbers: small enough to be sent to every task.
    chosen = given.orderBy(F.xxhash64("_key", F.lit(11)), "_key", *CHAIN).limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    sample = (F.broadcast(chosen).join(texts, "_key")
              .orderBy(F.xxhash64("_key", F.lit(11)), "_key", F.xxhash64("text")).limit(rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(batch.column("text")):
                hashes, offsets = features(part)
                found = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                own = [batch.column(name).slice(first, len(part)) for name in CHAIN]
                folds = [int(k) % FOLDS for k in batch.column("fold").slice(first, len(part)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(folds, pa.int32()), *own],
                                                 names=["hashes", "fold", *CHAIN])

    fold = F.pmod(F.xxhash64("_key", F.lit(13)), F.lit(FOLDS)).alias("fold")
    got = (sample.select("text", fold, *CHAIN)
           .mapInArrow(extract, "hashes binary, fold int, " + ", ".join(f"{name} int" for name in CHAIN)).toArrow())
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in got["hashes"]]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    y = np.column_stack([got[name].to_numpy() for name in CHAIN]) if len(parts) else np.zeros((0, len(CHAIN)))
    return fit_chain(np.concatenate([*parts, np.zeros(0, np.uint64)]), offsets, got["fold"].to_numpy(), y)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, reject: str = "toxic", key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per document: key, a probability per category, rejected, and a hash of the text.

    A null text counts as empty and gets the models' base rates. Repeated rows and null keys are scored like others; other
    columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for first, part in blocks(batch.column("text")):
                chances = chain.probabilities(*features(part))
                own = [batch.column(name).slice(first, len(part)) for name in ("doc_id", "content")]
                yield pa.RecordBatch.from_arrays(
                    [own[0], *[pa.array(chances[:, k]) for k in range(len(chain.names))],
                     pa.array(chances[:, chain.names.index(reject)] >= threshold), own[1]],
                    names=["doc_id", *[f"p_{name}" for name in chain.names], "rejected", "content"])

    schema = "doc_id long, " + "".join(f"p_{name} double, " for name in chain.names) + "rejected boolean, content long"
    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.xxhash64(text_or_empty(text)).alias("content"))
            .mapInArrow(run, schema).withColumnRenamed("doc_id", key))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` with a chain trained on ``labels`` (doc_id, quality, toxic) of ``docs``."""
    return score(docs, train(docs, labels, key=key, text=text), key=key, text=text)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the chain does not reject, with all their columns, repeated rows included.

    Decided in place, task by task: the texts are not shuffled.
    """
    chain = train(docs, labels, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    column = docs.columns.index(text)
    reject = chain.names.index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(batch.column(column)):
                keep = shared.value.probabilities(*features(part))[:, reject] < THRESHOLD
                yield batch.slice(first, len(part)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
