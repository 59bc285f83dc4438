"""Byte-level BPE by a segment tree over byte positions.

Every position holds the rank of the pair it forms with its live right neighbour; the tree keeps the leftmost
smallest rank of each range. A merge reads the root, joins two neighbours and updates three leaves, each along
one path to the root, so a stretch of n bytes takes O(n log n) however long it is. Short stretches are merged many at
a time: one row of an array per tree, one merge in every tree per step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dealscope.llm.text import blocks
from dealscope.llm.tokens import ENCODE_BYTES, ranks, shared_cache

#: Above every rank; ranks times the positions of any stretch must fit a long.
NO_PAIR = 1 << 31
TOGETHER_BYTES = 64


class Vocabulary:
    """Ranks of byte strings, and of the pairs of ranks whose bytes join to a ranked string."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken"):
        self.rank = ranks(name)
        self.word = {rank: word for word, rank in self.rank.items()}
        self.number = {rank: f" {rank}" for rank in self.word}
        rank = self.rank
        found = sorted(((rank[word[:i]] << 32) + rank[word[i:]], whole) for word, whole in rank.items()
                       for i in range(1, len(word)) if word[:i] in rank and word[i:] in rank)
        self.pair_keys = np.array([key for key, _ in found], np.int64)
        self.pair_ranks = np.array([whole for _, whole in found], np.int64)
        self.single = np.array([rank[bytes([i])] for i in range(256)], np.int64)

    def pair(self, left: int, right: int) -> int:
        """Rank of the joined pair, NO_PAIR if it has none."""
        return self.rank.get(self.word[left] + self.word[right], NO_PAIR)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same for arrays."""
        keys = (left << 32) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)


def encode_piece(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one pre-token."""
    whole = vocabulary.rank.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    ids = [vocabulary.rank[piece[i:i + 1]] for i in range(size)]
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    leaves = 1 << (size - 1).bit_length()
    # A node holds rank * leaves + position: the smallest is the leftmost of the smallest ranks.
    nothing = NO_PAIR * leaves
    tree = [nothing] * (2 * leaves)
    for i in range(size - 1):
        tree[leaves + i] = vocabulary.pair(ids[i], ids[i + 1]) * leaves + i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def update(position: int, value: int) -> None:
        node = leaves + position
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left < right else right
            if tree[node] == best:
                return
            tree[node] = best
            node >>= 1

    while tree[1] < nothing:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        ids[at] = rank
        right = after[gone]
        after[at] = right
        update(gone, nothing)
        if right < size:
            before[right] = at
            update(at, vocabulary.pair(rank, ids[right]) * leaves + at)
        else:
            update(at, nothing)
        left = before[at]
        if left >= 0:
            update(left, vocabulary.pair(ids[left], rank) * leaves + left)
    out, at = [], 0
    while at < size:
        out.append(ids[at])
        at = after[at]
    return out


def encode_together(pieces: list[bytes], vocabulary: Vocabulary, leaves: int) -> list[list[int]]:
    """``encode_piece`` for many pieces of 2 to ``leaves`` bytes at once."""
    count = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, count)
    raw = np.frombuffer(b"".join(piece.ljust(leaves, b"\0") for piece in pieces), np.uint8).reshape(count, leaves)
    ids = vocabulary.single[raw]
    place = np.arange(leaves)
    after = np.tile(place + 1, (count, 1))
    before = np.tile(place - 1, (count, 1))
    nothing = NO_PAIR * leaves
    tree = np.full((count, 2 * leaves), nothing, np.int64)
    ranks = vocabulary.pairs(ids[:, :-1], ids[:, 1:])
    ranks[place[None, :-1] + 1 >= sizes[:, None]] = NO_PAIR
    tree[:, leaves:-1] = np.minimum(ranks * leaves + place[:-1], nothing)
    width = leaves
    while width > 1:
        width //= 2
        pair = tree[:, 2 * width:4 * width].reshape(count, width, 2)
        tree[:, width:2 * width] = pair.min(axis=2)

    live = np.flatnonzero(tree[:, 1] < nothing)
    while len(live):
        rank, at = np.divmod(tree[live, 1], leaves)
        gone = after[live, at]
        right = after[live, gone]
        ids[live, at] = rank
        after[live, at] = right
        inner = right < sizes[live]
        safe = np.where(inner, right, 0)
        value = np.where(inner, vocabulary.pairs(rank, ids[live, safe]), NO_PAIR)
        before[live[inner], right[inner]] = at[inner]
        left = before[live, at]
        outer = left >= 0
        left_safe = np.where(outer, left, at)
        left_value = np.where(outer, vocabulary.pairs(ids[live, np.where(outer, left, 0)], rank), value)
        tree[live, leaves + gone] = nothing
        tree[live, leaves + at] = np.minimum(value * leaves + at, nothing)
        tree[live, leaves + left_safe] = np.minimum(left_value * leaves + left_safe, nothing)
        for changed in (gone, at, left_safe):
            node = (leaves + changed) >> 1
            while node[0]:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                node = node >> 1
        live = live[tree[live, 1] < nothing]

    starts = np.zeros((count, leaves + 1), bool)
    starts[:, 0] = True
    at = np.zeros(count, np.int64)
    rows = np.arange(count)
    while len(rows):
        at = after[rows, at]
        inside = at < sizes[rows]
        rows, at = rows[inside], at[inside]
        starts[rows, at] = True
    starts = starts[:, :-1]
    flat = ids[starts].tolist()
    ends = np.cumsum(starts.sum(axis=1)).tolist()
    return [flat[first:last] for first, last in zip([0, *ends], ends)]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each pre-token; short ones with a tree of the same size are merged together."""
    out: list[list[int]] = [[]] * len(pieces)
    together: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.rank.get(piece)
        if whole is not None:
            out[i] = [whole]
        elif len(piece) > TOGETHER_BYTES:
            out[i] = encode_piece(piece, vocabulary)
        else:
            together.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for leaves, members in together.items():
        for at in range(0, len(members), 4096):
            part = members[at:at + 4096]
            for i, ids in zip(part, encode_together([pieces[i] for i in part], vocabulary, leaves)):
                out[i] = ids
    return out


def encoder(vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
    """A function from texts to (ids as decimal numbers, each after a space; bytes the ids decode to)."""
    split = regex.compile(pattern)

    def encode(texts: list[str]) -> list[tuple[str, bytes]]:
        cut = [split.findall(text) for text in texts]
        pieces = list(set().union(*cut))
        known = {}
        for piece, ids in zip(pieces, encode_pieces([piece.encode() for piece in pieces], vocabulary)):
            known[piece] = "".join([vocabulary.number[i] for i in ids]), b"".join([vocabulary.word[i] for i in ids])
        return [known[own[0]] if len(own) == 1 else
                ("".join([known[p][0] for p in own]), b"".join([known[p][1] for p in own])) for own in cut]

    return encode


def bpe_round_trip(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", key: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids: n_tokens, ids_sha256, decoded_sha256 (and the ids on request).

    ids_sha256 is taken over the decimal ids joined by single spaces, decoded_sha256 over the decoded bytes, both in lower-case
    hexadecimal. A null text counts as empty: no tokens, digests of the empty string. Repeated rows and null keys are
    kept as they are; other columns are ignored; no rows give no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_cache(f"segment tree {name}", lambda: encoder(Vocabulary(name)))
        for batch in batches:
            for first, part in blocks(batch.column(1), ENCODE_BYTES):
                found: list[list] = [[], [], [], []]
                for own in cache.values(part.to_pylist()):
                    numbers, plain = zip(*own) if own else ((), ())
                    joined = "".join(numbers)[1:]
                    found[0].append(joined.count(" ") + 1 if joined else 0)
                    found[1].append(hashlib.sha256(joined.encode()).hexdigest())
                    found[2].append(hashlib.sha256(b"".join(plain)).hexdigest())
                    if with_ids:
                        found[3].append([int(x) for x in joined.split()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(found[0], pa.int64()),
                     pa.array(found[1], pa.string()), pa.array(found[2], pa.string()),
                     *[pa.array(x, pa.list_(pa.int32())) for x in found[3:] if with_ids]],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)
