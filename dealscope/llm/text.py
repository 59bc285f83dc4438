"""Vectorised words, word hashes and five-word shingles of Arrow text columns.

Everything works on blocks of rows of bounded size, so memory follows the longest single text and
not the table. A word is a run of bytes above the space (0x20) of the lower-cased UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # any odd number: it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_family(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7919))
_PLACE = hash_family(SHINGLE_WORDS, 1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64; kept for blocks of the usual size."""
    if len(_powers[base]) < count:
        steps = np.full(count, base, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps)
        if count > 8 * BLOCK_BYTES:
            return table
        _powers[base] = table
    return _powers[base][:count]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``limit`` bytes of text each, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    if not len(column):
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, column.slice(first, last - first)
        first = last


class Block:
    """Words of some texts: byte spans in ``data``, and the rows they belong to."""

    def __init__(self, texts: pa.Array, lower: bool = True, is_word: np.ndarray | None = None):
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.utf8_lower(texts)
        self.rows = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, self.rows + 1, texts.offset * 8) \
            if self.rows else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if self.rows else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size \
            else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        kind = (self.data > 32).astype(np.uint8) if is_word is None else is_word[self.data]
        size = len(kind)
        change = np.ones(size, bool)
        change[1:] = kind[1:] != kind[:-1]
        change[self.offsets[:-1][self.offsets[:-1] < size]] = True
        runs = np.flatnonzero(change)
        ends = np.append(runs[1:], size)
        words = kind[runs] > 0 if size else np.zeros(0, bool)
        self.starts, self.ends = runs[words], ends[words]
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self._sums: np.ndarray | None = None

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
        size = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, size), out=self._sums[1:])
        if not len(starts):
            return np.zeros(0, np.uint64)
        value = (self._sums[ends] - self._sums[starts]) * _power(_INVERSE, size)[starts]
        return mix(value + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def shingles(self, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every shingle, in order.

        A text of fewer words has one shingle of them all; a text without words has none.
        """
        hashes = self.word_hashes()
        count = len(hashes)
        places = _PLACE if words == SHINGLE_WORDS else hash_family(words, 1)
        padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
        index = np.arange(count)
        last = self.firsts[self.row + 1]
        value = np.zeros(count, np.uint64)
        for step in range(words):
            value += np.where(index + step < last, padded[step:step + count], np.uint64(0)) * places[step]
        keep = (index + words <= last) | (index == self.firsts[self.row])
        return mix(value[keep]), index[keep]


def distinct_sorted(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row: (hashes, offsets of the rows)."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (hashes, offsets of the rows)."""
    block = Block(texts)
    hashes, index = block.shingles()
    return distinct_sorted(hashes, block.row[index], block.rows)
