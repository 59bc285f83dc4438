"""Hard negatives, lattice scores and ranked search against brute force, on odd rows, empty tables and in the sample."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from dealscope.llm import hard_negatives as hn
from dealscope.llm.hard_negatives import Search, Subtree, hard_negatives, tile
from dealscope.llm.language_model import CLASSES, PRIOR_WORDS, Pieces, VOCABULARY, lattice_scores
from dealscope.llm.lattice import Lattice, Trie, chunked, read_pieces
from dealscope.llm.queries import QUERIES
from dealscope.llm.ranked_search import Postings, Queries, ranked_documents, weight_of
from llm_rows import LONG, documents

# Hard negatives.

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def brute_negatives(rows, every=100, scale=256, positives=5, negatives=10):
    kept = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(float(np.float32(x)) * scale) for x in vector]
        if sum(x * x for x in whole) < 2 ** 62:
            kept[key] = min(kept.get(key, (label, whole)), (label, whole))
    out = set()
    for key, (label, vector) in kept.items():
        if key % every:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, other)), k, own == label) for k, (own, other) in kept.items() if k != key]
        for score, positive, _ in sorted(r for r in scored if r[2])[:positives]:
            fit = sorted(r for r in scored if not r[2] and 30 * -score <= 100 * -r[0] <= 90 * -score)
            out |= {(key, positive, rank, k, -score, -s) for rank, (s, k, _) in enumerate(fit[:negatives], 1)}
    return out


def negatives_of(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(7) for n in ("id", "vector", "raw", "subtree", "block", "rank")})
    out = hard_negatives(df, F.col("id") % 100 == 0, **options)
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_negatives_odd_rows(spark):
    nan, big = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [1.0, 0.25, 9.0], 1), (2, [0.5], 2), (3, [0.5, 0.0], 2), (4, [], 1),
            (5, None, 1), (6, [1.0, None], 1), (7, [1.0, nan], 2), (8, [1.0, big], 2), (9, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (10, [0.75, 0.5], 2), (10, [0.75, 0.5], 2), (10, [0.7, 0.5], 2), (11, [3e38, 1.0], 2), (200, [-1.0, -1.0], 3),
            (12, [1e5, 1e5], 2), (300, [2e5, 0.0], 4), (13, [2e5, 1.0], 4), (14, [1.2e5, 0.0], 5)]
    got = negatives_of(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 8


def test_negatives_ties_and_a_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector with many labels: ties go to the smaller identifier in every subtree."""
    monkeypatch.setattr(hn, "SUBTREE_ROWS", 100)
    random = np.random.default_rng(3)
    hot = random.normal(size=8).tolist()
    rows = [(i, hot if i % 3 == 0 else (random.normal(size=8) + np.array(hot)).tolist(), int(i) % 4) for i in range(1500)]
    assert negatives_of(spark, rows) == brute_negatives(rows)


def test_negatives_empty(spark):
    assert negatives_of(spark, []) == set()
    assert negatives_of(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == set()


def test_negatives_query(spark, folder):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op11_str_rtree_negatives"](spark, folder).collect()}
    assert got == brute_negatives(rows)


def test_tree_prunes_clustered_rows():
    """Boxes hold their rows, bounds hold for every row, and a search of clustered rows opens few leaves."""
    random = np.random.default_rng(5)
    centres = random.normal(scale=400, size=(40, 6))
    vectors = np.concatenate([c + random.normal(scale=10, size=(200, 6)) for c in centres]).astype(np.int64)
    labels, ids = np.arange(len(vectors)) % 3, np.arange(len(vectors))
    order = tile(vectors, labels, ids)
    assert sorted(order.tolist()) == ids.tolist()
    tree = Subtree(ids[order], labels[order], vectors[order])
    search = Search(tree.prepared(tree.kind(vectors)), vectors[17].astype(float))
    exact = tree.vectors @ vectors[17]
    for leaf, start in enumerate(tree.starts):
        part = exact[start:start + hn.LEAF_ROWS]
        assert search.lower[leaf] <= part.min() and part.max() <= search.upper[leaf]
    found = search.best(2, False, 10)
    want = sorted(((-s, k) for s, k, own in zip(exact, tree.ids, tree.labels) if own != 2))[:10]
    assert [(-s, k) for s, k in sorted(found, key=lambda r: (-r[0], r[1]))] == [(int(s), int(k)) for s, k in want]
    assert len(search.known) < len(tree.starts) / 3


# Lattice scores.

def brute_lattice(word, pieces):
    """Sum over all segmentations, written out."""
    text, total = b" " + word.encode(), 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        ends = [i + 1 for i, cut in enumerate(cuts) if cut] + [len(text)]
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in pieces for p in parts):
            total += math.exp(sum(pieces[p] for p in parts))
    return math.log(total)


def test_lattice_sums_all_segmentations():
    own = Pieces(VOCABULARY)
    names, _ = read_pieces(VOCABULARY)
    weights = dict(zip(names, own.log_weight))
    import pyarrow as pa
    words = ["a", "the", "other", "ñan", "日本", "x|y", "zzzzzzzz", "▁", "\0q"]
    got = own.log_likelihood(pa.array(words))
    for word, value in zip(words, got):
        assert value == pytest.approx(brute_lattice(word, weights) + own.log_end, abs=1e-9)


def test_expected_counts_are_derivatives():
    """The expected number of a piece is the slope of the log-likelihood in its log weight."""
    names = [bytes([b]) for b in range(256)] + [b" ab", b"ab", b"ba", b"aba", b"bab"]
    names = sorted(set(names))
    weight = np.log(np.random.default_rng(1).dirichlet(np.ones(len(names))))
    import pyarrow as pa
    (rows, data, offsets), = chunked(pa.array(["ababab", "b", "abba"]))
    lattice = Lattice(Trie(names), data, offsets)
    copies = np.array([2.0, 1.0, 3.0])
    expected = lattice.expected(weight, copies)
    for piece in (b"ab", b"aba", b"a", b" ab", b" "):
        i, step = names.index(piece), 1e-6
        up, down = weight.copy(), weight.copy()
        up[i] += step
        down[i] -= step
        slope = (copies @ (lattice.log_likelihood(up) - lattice.log_likelihood(down))) / (2 * step)
        assert expected[i] == pytest.approx(slope, abs=1e-5)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scores(rows, rounds):
    """key -> (held_out, n_tokens, n_known, train_tokens, base, score) for rows of (key, text, class)."""
    import pyarrow as pa
    held = [zlib.crc32(str("" if k is None else k).encode()) % 10 == 0 for k, _, _ in rows]
    train = [(words_of(t), c) for (_, t, c), h in zip(rows, held) if not h]
    count = Counter(w for ws, _ in train for w in ws)
    classes = Counter(c for _, c in train if c is not None)
    top = [c for c, _ in sorted(classes.items(), key=lambda x: (-x[1], x[0]))[:CLASSES]]
    parts = [[ws for ws, c in train if c == own] for own in top] + [[ws for ws, c in train if c not in top]]
    parts = [p for i, p in enumerate(parts) if p] or [[]]
    tokens, kinds = sum(count.values()) + len(train), len(count) + bool(train)
    once, twice = (sum(v == n for v in count.values()) for n in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice))) if once else 0.5
    pieces = Pieces(VOCABULARY)
    for _ in range(rounds if count else 0):
        pieces = Pieces(VOCABULARY, pieces.expected(pa.array(sorted(count))))

    def share(n, total, kinds, novel):
        return (max(n - discount, 0) + discount * kinds * novel) / total if total else novel

    every = sorted({w for _, t, _ in rows for w in words_of(t)})
    novel = dict(zip(every, np.exp(pieces.log_likelihood(pa.array(every, pa.string())))))
    novel = {w: share(count[w], sum(count.values()), len(count), p) for w, p in novel.items()}
    models = []
    for part in parts:
        own = Counter(w for ws in part for w in ws)
        size = sum(own.values())
        models.append((own, size, (len(part) + 0.5) / (size + len(part) + 1), (len(part) + 0.5) / (len(train) + 0.5 * len(parts))))
    out = []
    for (key, text, _), is_held in zip(rows, held):
        ws = words_of(text)
        base = sum(math.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1))) for c in [*(count[w] for w in ws), len(train)])
        logs = [math.log(prior) + math.log(end) + sum(math.log((1 - end) * share(own[w], size, len(own), novel[w])) for w in ws)
                for own, size, end, prior in models]
        most = max(logs)
        score = (most + math.log(sum(math.exp(x - most) for x in logs))) / math.log(10)
        out.append((key, is_held, len(ws) + 1, sum(count[w] > 0 for w in ws) + bool(train), tokens, base, score))
    return out


def same_scores(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


SCORES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("hot", [0, 5, 100_000])
def test_scores_odd_rows(spark, odd, hot):
    """Frequent words looked up and all words joined give the same."""
    langs = odd.withColumns({"lang": F.when(F.col("doc_id") < 5, "de").when(F.col("doc_id") < 9, "en"), "hash": F.lit(7), "all": F.lit(7),
                             "class": F.lit(7), "word": F.lit(7), "key": F.lit(7), "held_out": F.lit(7)})
    rows = [(r.doc_id, r.text, r.lang) for r in langs.collect()]
    same_scores(lattice_scores(langs, hot_words=hot).select(*SCORES).collect(), brute_scores(rows, 2))


def test_scores_empty(spark, empty):
    assert lattice_scores(empty).count() == 0
    alone = documents(spark, [(6, "nothing here to learn from")]).withColumn("lang", F.lit(None).cast("string"))
    rows = [(6, "nothing here to learn from", None)]
    assert zlib.crc32(b"6") % 10 == 0
    got = lattice_scores(alone).select(*SCORES).collect()
    same_scores(got, brute_scores(rows, 2))
    assert got[0].train_tokens == 0 and got[0].base_score == 0.0 and got[0].score < -5


def test_scores_sample(spark, folder, sample):
    rows = [(r.doc_id, r.text, r.lang) for r in sample.collect()]
    same_scores(QUERIES["op12_subword_lattice"](spark, folder).select(*SCORES).collect(), brute_scores(rows, 2))


def test_weights_make_a_distribution(spark):
    """First pieces sum to one, as do later ones and the end of a word."""
    own = Pieces(VOCABULARY)
    names, _ = read_pieces(VOCABULARY)
    first = np.array([n[:1] == b" " for n in names])
    assert np.exp(own.log_weight[first]).sum() == pytest.approx(1)
    assert np.exp(own.log_weight[~first]).sum() + math.exp(own.log_end) == pytest.approx(1)
    assert PRIOR_WORDS > 0


# Ranked search.

def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, top=20):
    read = [(k, Counter(t)) for k, t in ((k, terms_of(t)) for k, t in docs) if t]
    lengths = [sum(c.values()) for _, c in read]
    total, df = sum(lengths), Counter(w for _, c in read for w in c)
    asked = {}
    for key, text in items:
        if text is not None:
            asked[key] = min(asked.get(key, text), text)
    out = set()
    for item, text in asked.items():
        terms = Counter(terms_of(text))
        found = []
        for (key, own), n in zip(read, lengths):
            m = 75 + 25 * n * len(read) // total
            score = sum(r * weight_of(len(read), df[w]) * (10 ** 9 * own[w] // (1000 * own[w] + 12 * m)) for w, r in terms.items() if own[w])
            if score > 0:
                found.append((-score, key is None, key or 0))
        out |= {(item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(found)[:top], 1)}
    return out


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def ranks_of(docs, items, **options):
    got = [tuple(r) for r in ranked_documents(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ranks_odd_rows(spark, odd):
    asked = [(1, "Same TEXT, of some-words; same"), (2, "word1x1 word2x2 alpha"), (3, None), (4, ""), (5, " ... "), (6, "unknownterm"),
             (None, "one żółć"), (7, "beta"), (7, "alpha beta"), (8, LONG), (9, "日本語 a b c don t 12 ½")]
    items = spark.createDataFrame(asked, ITEMS).withColumns({n: F.lit(7) for n in ("query", "rank", "score", "key", "n", "terms", "tf")})
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    docs = odd.withColumns({n: F.lit(7) for n in ("query", "score", "key", "n", "terms", "tf")})
    assert ranks_of(docs, items) == brute_ranks(rows, asked)


def test_ranks_empty(spark, empty, odd):
    items = spark.createDataFrame([(1, "alpha")], ITEMS)
    assert ranks_of(empty, items) == set()
    assert ranks_of(odd, items.limit(0)) == set()


@pytest.mark.parametrize("shard", [200, 3000, 1 << 20])
def test_ranks_ties_and_hot_terms(spark, monkeypatch, shard):
    """Copies and terms that stand everywhere, in shards and intervals of any size."""
    from dealscope.llm import ranked_search
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search, "SMALL", 16)
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    docs = [(i, "the same common text the" if i % 3 == 0 else " ".join(random.choice(words, random.integers(1, 40), p=odds / odds.sum())))
            for i in range(1200)]
    asked = [(i, " ".join(random.choice(words, 9)) + " the") for i in range(12)]
    got = ranks_of(documents(spark, docs).repartition(5), spark.createDataFrame(asked, ITEMS))
    assert got == brute_ranks(docs, asked)


def test_ranks_rounds(spark, monkeypatch, sample):
    from dealscope.llm import ranked_search
    asked = [(i, r.text[:300]) for i, r in enumerate(sample.where("length(text) > 300").orderBy("doc_id").limit(6).collect())]
    items = spark.createDataFrame(asked, ITEMS)
    docs = sample.limit(300)
    want = ranks_of(docs, items)
    monkeypatch.setattr(ranked_search, "ROUND_CHARS", 900)
    assert ranks_of(docs, items) == want == brute_ranks([(r.doc_id, r.text) for r in docs.collect()], asked)


def test_search_opens_few_intervals(monkeypatch):
    """A few documents hold a rare term: the bounds leave most documents unscored."""
    random = np.random.default_rng(4)
    size = 20_000
    texts = Queries(["rare common"])
    part = [np.full(size, 1000), random.integers(900_000, 990_000, 30)]
    document = [np.arange(size), random.choice(size, 30, replace=False)]
    lists = Postings(np.arange(size), np.concatenate(document), np.repeat([0, 1], [size, 30]), np.concatenate(part), len(texts.hashes))
    opened = []
    ranges = lists.ranges
    monkeypatch.setattr(lists, "ranges", lambda *a: opened.append(a) or ranges(*a))
    best = []
    lists.search(np.array([0, 1]), np.array([10, 5000]), 20, best)
    want = sorted((5000 * p + 10_000, -d) for p, d in zip(part[1].tolist(), document[1].tolist()))[-20:]
    assert sorted(best) == want and len(opened) < 120


def test_range_maxima():
    random = np.random.default_rng(6)
    pairs = [(t, d) for t, d in zip(random.integers(0, 3, 900).tolist(), random.integers(0, 400, 900).tolist())]
    pairs = sorted(set(pairs))
    term, document = (np.array(x) for x in zip(*pairs))
    part = random.integers(1, 50, len(pairs))
    lists = Postings(np.arange(400), document, term, part, 3)
    for _ in range(300):
        low, high = sorted(random.integers(0, 401, 2).tolist())
        begin, end = lists.ranges(np.arange(3), low, high)
        for t in range(3):
            inside = [p for (a, d), p in zip(pairs, part.tolist()) if a == t and low <= d < high]
            assert end[t] - begin[t] == len(inside)
            if inside:
                assert lists.part[lists.maxima(begin[t:t + 1], end[t:t + 1])[0]] == max(inside)
