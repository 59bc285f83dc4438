"""Exact duplicates, packing, byte-level BPE and fingerprints against brute force."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from dealscope.llm import bpe, sketch, tokens
from dealscope.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from dealscope.llm.packing import CAPACITY, Plan, cut, pack_documents
from dealscope.llm.text import shingle_sets
from dealscope.llm.tokens import chunks, ranks
from llm_rows import LONG, ODD, documents


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_odd_rows(odd):
    rows = exact_duplicates(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in ODD)
    groups = defaultdict(list)
    for key, text in ODD:
        groups[hashlib.sha256(plain(text).encode()).hexdigest()].append(key)
    kept = Counter()
    for r in rows:
        keys = groups[r.text_sha256]
        assert r.group_size == len(keys)
        assert r.keep_id == min((k for k in keys if k is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert Counter(len(g) for g in groups.values())[4] == 1


def test_exact_drop_keeps_columns(odd):
    left = drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert Counter(plain(r.text) for r in left.collect()) == Counter({plain(t): 1 for _, t in ODD})


def test_exact_empty(empty):
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_exact_many_runs(spark, fan):
    """A third of the rows are one text; every fan gives the same groups over many runs."""
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 200}") for i in range(3000)]
    got = exact_duplicates(documents(spark, rows).repartition(16), fan=fan).collect()
    first, size = {}, Counter(t for _, t in rows)
    for key, text in rows:
        first.setdefault(text, key)
    texts = dict(rows)
    assert len(got) == 3000
    assert all((r.keep_id, r.group_size, r.kept) == (first[texts[r.doc_id]], size[texts[r.doc_id]],
                                                     first[texts[r.doc_id]] == r.doc_id) for r in got)


def check_packed(rows, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = Counter()
    for key, text in texts:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, (start, length) in enumerate(cut(len(ids), CAPACITY)):
            want[key, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= CAPACITY
        assert sum(3 * length > CAPACITY for _, length in inside) <= 2
    return len(bins)


def test_packing_odd_rows(odd, empty):
    check_packed(pack_documents(odd).collect(), ODD)
    assert pack_documents(empty).count() == 0


def test_packing_sample(sample):
    texts = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    rows = pack_documents(sample).collect()
    used = check_packed(rows, texts)
    least = sum(r.length for r in rows) / CAPACITY
    assert used <= 1.03 * least + 1


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_all(seed):
    random = np.random.default_rng(seed)
    capacity = int(random.choice([7, 10, 30, 100]))
    counts = {int(x): int(random.integers(1, 30)) for x in random.integers(1, capacity + 1, 12)}
    plan, bins = Plan(counts, capacity), defaultdict(list)
    assert plan.placed == counts and not any(plan.left.values())
    for length, _, count, per_bin, first, offset in plan.rules:
        for b in range(count):
            bins[first + b] += [(offset + k * length, length) for k in range(per_bin)]
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    # Best-fit decreasing never needs more than 11/9 of the least possible number, and a bin.
    assert len(bins) <= 11 / 9 * -(-sum(k * v for k, v in counts.items()) // capacity) * 1.5 + 1


def test_plan_pairs_large_items():
    plan = Plan({60: 3, 40: 2, 35: 2}, 100)
    assert plan.bins == 4


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks("byte_bpe_50k.tiktoken"), special_tokens={})


def test_bpe_odd_rows(odd, empty, encoding):
    got = bpe.bpe_round_trip(odd, with_ids=True).collect()
    want = Counter((k, tuple(encoding.encode_ordinary(t or ""))) for k, t in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(encoding.decode_bytes(r.ids)).hexdigest()
    assert Counter(r.decoded_sha256 for r in got) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    assert bpe.bpe_round_trip(empty).count() == 0


def test_bpe_sample(sample, encoding):
    texts = {r.doc_id: r.text for r in sample.select("doc_id", "text").collect()}
    for r in bpe.bpe_round_trip(sample).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_single_and_together_agree(encoding):
    vocabulary = bpe.Vocabulary()
    random = np.random.default_rng(1)
    pieces = [bytes(random.integers(97, 101, random.integers(1, 90)).astype(np.uint8)) for _ in range(500)] + [b"\xff\xfe" * 30, b"a" * 5000]
    together = bpe.encode_pieces(pieces, vocabulary)
    assert together == [bpe.encode_piece(p, vocabulary) for p in pieces]
    assert together == [encoding._encode_single_piece(p) for p in pieces]


@pytest.mark.parametrize("text", ["", " ", "a b", "a  b", " a", "a ", "a \n b", "a\n\n b c", "x　 y", "a\0 b", "\x1c a"])
def test_chunks_join_to_ids(encoding, text):
    assert "".join(chunks(text)) == text
    assert sum((encoding.encode_ordinary(c) for c in chunks(text)), []) == encoding.encode_ordinary(text)


def test_chunk_numbers_agree_with_chunks_one_by_one():
    texts = ["", " ", "a b", "a  b", " a", "a ", "żółć 日本語", "a \n b", "x\u3000 y", "a\0 b", "\x1c a", "a b", "é b c", "tab\there so"]
    cut, counts, rows = tokens.chunk_array(np_array(texts).cast("large_string"))
    ends, flat = np.cumsum(counts), cut.to_pylist()
    got = {int(row): [c for c in flat[end - count:end] if c] for row, count, end in zip(rows, counts, ends)}
    assert got == {i: [c for c in chunks(t) if c] for i, t in enumerate(texts)}
    table = tokens.IdTable(lambda missing: [np.frombuffer(m.encode(), np.uint8).astype("<u4").tobytes() for m in missing], limit=3)
    for _ in range(3):
        rows, ids, bounds = table.texts(np_array(texts).cast("large_string"))
        assert {int(r): bytes(ids[a:b].astype(np.uint8)) for r, a, b in zip(rows, bounds, bounds[1:])} == {
            i: t.encode() for i, t in enumerate(texts)}


def test_known_chunks_are_kept_without_python_objects():
    asked = []

    def encode(missing):
        asked.extend(missing)
        return [len(m).to_bytes(4, "little") for m in missing]

    table = tokens.IdTable(encode)
    texts = np_array([" ".join(f"word{i}x{i % 7}" for i in range(at, at + 2000)) for at in range(0, 40_000, 1000)]).cast("large_string")
    tracemalloc.start()
    try:
        first = table.texts(texts)
        asked_once = len(asked)
        asked.clear()
        kept, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert asked_once == len(table.known) > 40_000 and kept < 4e6
    assert all(np.array_equal(a, b) for a, b in zip(first, table.texts(texts))) and not asked


def test_chunks_that_come_back_outlive_a_full_table():
    asked = []

    def encode(missing):
        asked.extend(missing)
        return [np.frombuffer(m.encode(), np.uint8).astype("<u4").tobytes() for m in missing]

    table = tokens.IdTable(encode, limit=8)
    for block in range(40):
        texts = ["the whole", *(f"the once{block}x{i}" for i in range(5))]
        rows, ids, bounds = table.texts(np_array(texts).cast("large_string"))
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(bounds, bounds[1:])] == [texts[r] for r in rows]
        assert len(table.known) <= 8 + 7
    assert asked.count("the") == asked.count(" whole") == 1 and len(asked) == len(set(asked)) == 2 + 40 * 5


def neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for i, (key, text) in enumerate(rows):
        yield key, text or "", rows[(i + 1) % len(rows)][1] or ""


def test_fingerprints_sample(sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in sketch.fingerprints(sample).collect()}
    assert len(got) == len(rows)
    errors, prints = [], {}
    for key, text, following in neighbours(rows):
        r, edited = got[key], sketch.edit(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, other, after = (set(shingle_sets(np_array([t]))[0].tolist()) for t in (text, edited, following))
        errors.append(abs(r.near_edited - len(one & other) / max(1, len(one | other))))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1
    assert np.mean(errors) < 0.08


def np_array(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_fingerprints_odd_rows(odd, empty):
    got = sketch.fingerprints(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ODD)
    want = {(k, len(t), hashlib.sha256(sketch.edit(t, n).encode()).hexdigest())
            for k, t, n in list(neighbours([r for r in ODD if r[0] is not None]))[:-1]}
    assert want <= {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}
    assert sketch.fingerprints(empty).count() == 0


def test_fingerprint_single_document(spark):
    r, = sketch.fingerprints(documents(spark, [(5, "one two three four five six")])).collect()
    assert r.near_next == 1


def test_fingerprints_merge_and_contain():
    words = [f"w{i}" for i in range(4000)]
    whole, left, right = sketch.sketches(np_array([" ".join(words), " ".join(words[:2004]), " ".join(words[2000:])]))
    assert sketch.merge(left, right).tolist() == whole.tolist()
    assert sketch.likeness(left, whole)[1] == 1 and abs(sketch.likeness(left, whole)[0] - 0.5) < 0.05
    assert sketch.decode(sketch.encode(whole)).tolist() == whole.tolist()
    assert LONG
