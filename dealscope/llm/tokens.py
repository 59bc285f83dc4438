"""Byte-level BPE over whole texts by way of a bounded cache of space-separated chunks.

The pre-tokeniser puts a single space at the front of the word it precedes and never joins across it.
So a text may be cut before every space that has no white space beside it, and each chunk be encoded on
its own: the ids of the text are those of its chunks in order.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 500_000
#: Texts are encoded in blocks of so many bytes, so that missing chunks are worked on together.
ENCODE_BYTES = 4 << 20

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_ASCII_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_WHITE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in _ASCII_WHITE + " "]


def _white_beside_space(text: str) -> bool:
    if "  " in text:
        return True
    kinds = _ASCII_WHITE if text.isascii() else [*_ASCII_WHITE, *_WHITE]
    return any(kind in text and (kind + " " in text or " " + kind in text) for kind in kinds)


def chunks(text: str) -> list[str]:
    if not text:
        return []
    if "\0" in text or _white_beside_space(text):
        return _SAFE_CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


class ChunkCache:
    """Encodes texts chunk by chunk; ``encode`` maps a list of distinct chunks to their values."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.known: dict[str, object] = {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks."""
        cut = [chunks(text) for text in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        missing = [chunk for chunk in set().union(*cut) if chunk not in known]
        if missing:
            known.update(zip(missing, self.encode(missing)))
        return [list(map(known.__getitem__, own)) for own in cut]


#: Bytes that beside a space may be white space, or part of it.
_MAYBE_WHITE = np.zeros(256, bool)
_MAYBE_WHITE[[*b" \t\n\v\f\r\x1c\x1d\x1e\x1f", *range(0x80, 0x100)]] = True


def _careful(texts: pa.LargeStringArray) -> np.ndarray:
    """Whether each text must be cut by ``_SAFE_CUT``; only texts with odd bytes beside a space are looked at one by one."""
    careful = np.zeros(len(texts), bool)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if offsets[-1] == offsets[0]:
        return careful
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    space, white = data == 32, _MAYBE_WHITE[data]
    odd = data == 0
    odd[:-1] |= space[:-1] & white[1:]
    odd[1:] |= white[:-1] & space[1:]
    rows = np.unique(np.searchsorted(offsets - offsets[0], np.flatnonzero(odd), "right") - 1)
    for row in rows.tolist():
        text = texts[row].as_py()
        careful[row] = "\0" in text or _white_beside_space(text)
    return careful


def chunk_array(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks of all texts, number of chunks of each text, row of each text): texts to be cut with care come last."""
    careful = _careful(texts)
    plain = texts if not careful.any() else texts.filter(pa.array(~careful))
    lists = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
    found, counts = [lists.flatten()], [pc.list_value_length(lists).to_numpy().astype(np.int64)]
    for row in np.flatnonzero(careful).tolist():
        own = _SAFE_CUT.split(texts[row].as_py())
        found.append(pa.array(own, pa.large_string()))
        counts.append(np.array([len(own)], np.int64))
    return pa.concat_arrays(found), np.concatenate(counts), np.concatenate([np.flatnonzero(~careful), np.flatnonzero(careful)])


class IdTable:
    """Ids of distinct chunks in one array; the ids of texts are gathered from it by chunk numbers.

    ``encode`` maps a list of distinct chunks to their ids as little-endian 32-bit numbers. Known chunks are one Arrow array, in
    which those of a block are looked up at once: no Python object is made for a chunk that is known, nor kept for any. When
    there are over ``limit``, those that no later block had are forgotten, as most chunks come once, and all if that leaves too many.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")
        self.starts = np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def _gathered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks of these numbers, and where each chunk's begin and the last one's end."""
        lengths = self.starts[which + 1] - self.starts[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(self.starts[which] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        self.known = self.known.take(pa.array(kept))
        self.ids, self.starts = self._gathered(kept)
        self.again = np.zeros(len(kept), bool)

    def _learn(self, missing: pa.LargeStringArray) -> None:
        found = list(self.encode(missing.to_pylist()))
        self.known = pa.concat_arrays([self.known, missing])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.again = np.concatenate([self.again, np.zeros(len(found), bool)])

    def _numbers(self, words: pa.LargeStringArray) -> np.ndarray:
        """Number of each of some distinct chunks, learnt where it is unknown."""
        if len(self.known) > self.limit:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        unknown = found.is_null().to_numpy(zero_copy_only=False)
        numbers = found.fill_null(0).to_numpy().astype(np.int64)
        self.again[numbers[~unknown]] = True
        if unknown.any():
            numbers[unknown] = len(self.known) + np.arange(unknown.sum())
            self._learn(words.filter(pa.array(unknown)))
        return numbers

    def texts(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each text, ids of all texts in that order, offsets of the texts in them)."""
        cut, counts, rows = chunk_array(texts)
        coded = cut.dictionary_encode()
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        ids, ends = self._gathered(which)
        return rows, ids, ends[np.concatenate([[0], np.cumsum(counts)])]


_shared: dict[str, object] = {}


def shared(name: str, make: Callable[[], object]) -> object:
    """What ``make`` makes, once for this worker process, which serves one task after another."""
    if name not in _shared:
        _shared[name] = make()
    return _shared[name]


def shared_cache(name: str, make: Callable[[], Callable[[list[str]], Iterable]]) -> ChunkCache:
    return shared(name, lambda: ChunkCache(make()))


def ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


_PLAIN = re.compile(r" ?[^\s]+")
_LINE_END = "\n"


def library_encoder(name: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of each chunk as little-endian 32-bit numbers, by the tokenizers library.

    Chunks without white space inside go to the library as lines of one text, as a call for each is dear: a line
    end beside them is a token of its own, found nowhere else, and the ids are cut there. The strings of
    special tokens are ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    line_end, = tokenizer.encode(_LINE_END, add_special_tokens=False).ids

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(one.ids, "<u4") for one in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(missing: list[str]) -> list[bytes]:
        out = [b""] * len(missing)
        plain = [i for i, chunk in enumerate(missing) if _PLAIN.fullmatch(chunk)]
        other = sorted(set(range(len(missing))).difference(plain))
        for at in range(0, len(plain), 2048):
            part = plain[at:at + 2048]
            found, = ids([_LINE_END.join([missing[i] for i in part])])
            ends = np.append(np.flatnonzero(found == line_end), len(found))
            if len(ends) != len(part):
                raise ValueError("the tokenizer joins line ends with words")
            raw, first = found.tobytes(), 0
            for i, end in zip(part, ends.tolist()):
                out[i] = raw[4 * first:4 * end]
                first = end + 1
        for at in range(0, len(other), 64):
            part = other[at:at + 64]
            for i, found in zip(part, ids([missing[i] for i in part])):
                out[i] = found.tobytes()
        return out

    return encode
