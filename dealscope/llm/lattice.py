"""All segmentations of words into subword pieces at once: forward and backward recursions in log space.

A word is its UTF-8 bytes after one space, the mark of a word's start. Its lattice has a node before, between and after
the bytes, and an edge for each piece that stands between two nodes. A path from the first node to the last is a
segmentation; its weight is the product of the weights of its pieces. Single bytes are pieces, so every word has a path.

Many words are worked on together: edges come from one walk down the trie of pieces for all start positions at once,
and each step of a recursion settles the nodes at one distance from the start (or end) for all words. Memory follows
the bytes of a chunk of words, or of the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

SPACE = b" "
_MARK = "▁"
#: Words are worked on in chunks of about so many bytes, none more than twice as long as another beyond SHORT bytes.
CHUNK_BYTES = 1 << 18
SHORT = 64


def read_pieces(name: str) -> tuple[list[bytes], np.ndarray]:
    """The byte strings of a vocabulary in sentencepiece's format, and the scores it gives them.

    The mark of a word's start becomes a space. Pieces with a mark elsewhere cannot occur inside a word and
    control pieces have no bytes; both are left out. Of the pieces of one string, as a letter and its byte, the better
    score counts; bytes without a score of their own rank below all pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found: dict[bytes, float] = {}
    lowest = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            piece, score = bytes([int(text[3:5], 16)]), lowest - 1.0
        else:
            piece, score = text.replace(_MARK, " ").encode(), model.get_score(i)
            if b" " in piece[1:]:
                continue
        found[piece] = max(found.get(piece, -np.inf), score)
    for byte in range(256):
        found.setdefault(bytes([byte]), lowest - 1.0)
    pieces = sorted(found)
    return pieces, np.array([found[p] for p in pieces])


class Trie:
    """Pieces by their prefixes: ``step`` moves many walks by one byte."""

    def __init__(self, pieces: list[bytes]):
        nodes: dict[bytes, int] = {b"": 0}
        keys: list[int] = []
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    keys.append(nodes[piece[:end - 1]] * 256 + piece[end - 1])
                    nodes[piece[:end]] = len(nodes)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.child = np.array(keys, np.int64)[order], order + 1
        self.root = np.full(256, -1, np.int64)
        self.root[self.keys[self.keys < 256]] = self.child[self.keys < 256]
        self.piece = np.full(len(nodes), -1, np.int64)
        for i, piece in enumerate(pieces):
            self.piece[nodes[piece]] = i

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where no piece goes on."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)


class Lattice:
    """The edges of some words. Slots number the nodes of all words, ``len(word) + 1`` for each."""

    def __init__(self, trie: Trie, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.words = len(lengths)
        self.first = offsets[:-1] + np.arange(self.words)
        self.last = self.first + lengths
        self.size = int(lengths.sum()) + self.words
        word = np.repeat(np.arange(self.words), lengths)
        at = np.arange(len(data))
        end = offsets[1:][word]
        starts, ends, pieces = [], [], []
        node, depth = trie.root[data], 0
        while True:
            live = node >= 0
            at, end, node, word = at[live], end[live], node[live], word[live]
            depth += 1
            whole = trie.piece[node] >= 0
            slot = at[whole] + word[whole]
            starts.append(slot)
            ends.append(slot + depth)
            pieces.append(trie.piece[node[whole]])
            inside = at + depth < end
            at, end, node, word = at[inside], end[inside], node[inside], word[inside]
            if not len(at):
                break
            node = trie.step(node, data[at + depth].astype(np.int64))
        self.start, self.end, self.edge_piece = map(np.concatenate, (starts, ends, pieces))
        self.owner = np.searchsorted(self.first, self.start, "right") - 1

    def _sweep(self, weights: np.ndarray, source: np.ndarray, target: np.ndarray, distance: np.ndarray,
               begin: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths from ``begin`` to every slot."""
        value = np.full(self.size, -np.inf)
        value[begin] = 0.0
        order = np.lexsort((target, distance))
        source, target, weight, distance = source[order], target[order], weights[order], distance[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        sizes = np.diff(np.append(heads, len(target)))
        steps = np.flatnonzero(np.concatenate([[True], distance[heads][1:] != distance[heads][:-1], [True]]))
        edge = np.append(heads, len(target))
        for low, high in zip(steps[:-1].tolist(), steps[1:].tolist()):
            part = slice(edge[low], edge[high])
            own = heads[low:high] - edge[low]
            terms = value[source[part]] + weight[part]
            most = np.maximum.reduceat(terms, own)
            value[target[heads[low:high]]] = most + np.log(
                np.add.reduceat(np.exp(terms - np.repeat(most, sizes[low:high])), own))
        return value

    def forward(self, log_weight: np.ndarray) -> np.ndarray:
        return self._sweep(log_weight[self.edge_piece], self.start, self.end, self.end - self.first[self.owner], self.first)

    def backward(self, log_weight: np.ndarray) -> np.ndarray:
        return self._sweep(log_weight[self.edge_piece], self.end, self.start, self.last[self.owner] - self.start, self.last)

    def log_likelihood(self, log_weight: np.ndarray) -> np.ndarray:
        """Per word, the natural log of the summed weight of its segmentations."""
        return self.forward(log_weight)[self.last]

    def expected(self, log_weight: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Per piece, its expected number over ``copies`` of each word, segmentations weighted by their likelihood."""
        ahead, behind = self.forward(log_weight), self.backward(log_weight)
        share = np.exp(ahead[self.start] + log_weight[self.edge_piece] + behind[self.end] - ahead[self.last][self.owner])
        return np.bincount(self.edge_piece, share * copies[self.owner], len(log_weight))


def chunked(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of the words, each after a space, short ones together and long ones with their like."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets) + 1
    order = np.argsort(lengths, kind="stable")
    total = np.cumsum(lengths[order])
    low = 0
    while low < len(order):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + CHUNK_BYTES, "right")))
        high = min(high, int(np.searchsorted(lengths[order], 2 * max(SHORT, lengths[order[low]]), "right")))
        rows = order[low:high]
        ends = np.concatenate([[0], np.cumsum(lengths[rows])])
        text = np.full(ends[-1], SPACE[0], np.uint8)
        inner = np.ones(ends[-1], bool)
        inner[ends[:-1]] = False
        text[inner] = data[np.repeat(offsets[rows] - ends[:-1] - 1, lengths[rows])[inner] + np.arange(ends[-1])[inner]]
        yield rows, text, ends
        low = high
