"""Near duplicates, repeated passages and connected components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from dealscope.llm import chaining, ngram_join
from dealscope.llm.components import components
from dealscope.llm.ngram_join import drop_near_duplicates, last_depth, near_duplicates, recall
from dealscope.llm.tables import maybe_among
from dealscope.llm.text import Block, shingle_sets
from llm_rows import LONG, ODD, documents


def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    """Smallest key of each row's class, by comparing all pairs that share a shingle."""
    sets = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s or [None] for j in holders[x] if j < i).items():
            if not s or both / (len(s) + len(sets[j]) - both) >= 0.8:
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [smallest.get(find(i)) for i in range(len(rows))]


def test_recall():
    assert recall(0.8, last_depth(0.8, 0.999)) >= 0.999 > recall(0.8, last_depth(0.8, 0.999) + 1)


def test_shingle_sets():
    texts = ["a b c d e f", "A  b\nc d e", "", "a b", None, "a b c d e"]
    hashes, offsets = shingle_sets(pa.array(texts))
    sets = [frozenset(hashes[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    assert [len(s) for s in sets] == [2, 1, 0, 1, 0, 1]
    assert sets[1] == sets[5] < sets[0]


def test_join_sample(sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in near_duplicates(sample).collect()}
    assert [got[k].class_id for k, _ in rows] == classes(rows)


def edited(random_, words, edits):
    words = list(words)
    for at in random_.sample(range(len(words)), edits):
        words[at] = f"new{random_.randrange(10 ** 6)}"
    return " ".join(words)


def test_join_large_groups(spark):
    """Hundreds of near copies of one text, and texts that share over half of it without being similar."""
    chance = random.Random(5)
    base = [f"w{chance.randrange(10 ** 6)}" for _ in range(150)]
    rows = [(i, edited(chance, base, chance.randrange(0, 4))) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:100] + [f"v{chance.randrange(10 ** 6)}" for _ in range(50)])) for i in range(60)]
    rows += [(2000 + i, edited(chance, base, 6)) for i in range(40)]
    chance.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert [got[k] for k, _ in rows] == classes(rows)


def test_join_counts_all_links(spark, monkeypatch):
    """Links of every text by brute force, in one block and in several."""
    chance = random.Random(11)
    base = [f"w{chance.randrange(10 ** 6)}" for _ in range(150)]
    rows = [(i, edited(chance, base, chance.randrange(0, 5))) for i in range(120)] + [(500, "one two three four five six"), (501, " ".join(base))]
    rows += [(502, " ".join(base)), (600, " ".join(base[:40])), (601, " ".join(base[:41]))]
    sets = {k: shingles(t) for k, t in rows}
    distinct = set(sets.values())
    want = {k: sum(len(s & o) >= 0.8 * len(s | o) for o in distinct if o != s) for k, s in sets.items()}
    for size in (ngram_join.BLOCK_SHINGLES, 3000):
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", size)
        got = near_duplicates(documents(spark, rows)).collect()
        assert {r.doc_id: r.n_links for r in got} == want


def test_join_odd_rows(odd, empty):
    got = near_duplicates(odd).collect()
    want = classes(ODD)
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip([k for k, _ in ODD], want))
    assert near_duplicates(empty).count() == 0
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = left.collect()
    assert len(kept) == len({r.class_root for r in got})
    assert drop_near_duplicates(empty).count() == 0


def test_filter_loses_no_wanted_row_and_most_others(spark):
    rows = spark.range(50_000).selectExpr("id as _key", "id % 3 as _content", "'t' || id as text", "7 as _bits")
    wanted = rows.where("_key % 10 = 0").select("_key", "_content")
    left = maybe_among(rows, wanted, ["_key", "_content"])
    assert left.columns == rows.columns
    keys = [r[0] for r in left.select("_key").collect()]
    assert set(range(0, 50_000, 10)) <= set(keys) and len(keys) == len(set(keys)) < 5000 + 0.06 * 45_000
    assert maybe_among(rows, wanted.where("false"), ["_key", "_content"]).count() == 0


def test_texts_are_filtered_before_they_are_joined(spark):
    """The optimizer keeps the filter below the exact join, so that what it drops is not shuffled."""
    rows = spark.range(1000).selectExpr("id as _key", "'t' || id as text")
    wanted = spark.range(0, 1000, 10).selectExpr("id as _key")
    plan = maybe_among(rows, wanted, ["_key"]).join(wanted, ["_key"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (_key") < plan.index("getbit")


def test_components(spark):
    chance = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 300)] + [(chance.randrange(400, 600), chance.randrange(400, 600)) for _ in range(80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def words(chance, count):
    return [f"w{chance.randrange(10 ** 7)}" for _ in range(count)]


def test_passages(spark):
    chance = random.Random(3)
    exact, fuzzy, short = words(chance, 60), words(chance, 80), words(chance, 45)
    changed = list(fuzzy)
    changed[20] = "other"
    changed.insert(50, "more")
    rows = [(1, words(chance, 30) + exact + words(chance, 9)), (2, words(chance, 11) + exact), (3, fuzzy + words(chance, 20)),
            (4, words(chance, 5) + changed), (5, short + words(chance, 80)), (6, words(chance, 80) + short),
            (7, exact[:30] + words(chance, 100)), (8, words(chance, 200)), (9, exact + fuzzy)]
    docs = documents(spark, [(k, " ".join(w)) for k, w in rows])
    got = chaining.repeated_passages(docs).collect()
    for r in got:
        assert r.source_id < r.doc_id and r.identity >= 0.8 and r.passage_words >= 50
    assert {r.doc_id for r in got} | {r.source_id for r in got} == {1, 2, 3, 4, 9}
    spans = {(r.doc_id, r.source_id): (r.start_word, r.end_word, r.source_start, r.source_end) for r in got}
    assert spans[2, 1] == (11, 71, 30, 90)
    assert spans[4, 3] == (5, 86, 0, 80)


def test_passages_sample(sample):
    """Every document with an exact run of fifty words found elsewhere is reported, and no unrelated one."""
    rows = [(r.doc_id, r.text.lower().split()) for r in sample.select("doc_id", "text").collect()]
    runs, near = defaultdict(set), defaultdict(set)
    for key, w in rows:
        for i in range(len(w) - 49):
            runs[tuple(w[i:i + 50])].add(key)
        for i in range(len(w) - 15):
            near[tuple(w[i:i + 16])].add(key)
    want = set().union(*(s for s in runs.values() if len(s) > 1))
    possible = set().union(*(s for s in near.values() if len(s) > 1))
    got = {k for r in chaining.repeated_passages(sample).collect() for k in (r.doc_id, r.source_id)}
    assert want <= got <= possible


def test_passages_hot(spark):
    """A passage in every document: each is reported, with few partners each."""
    chance = random.Random(4)
    common = words(chance, 70)
    rows = [(i, " ".join(words(chance, 40) + common + words(chance, 40))) for i in range(300)]
    got = chaining.repeated_passages(documents(spark, rows).repartition(12)).collect()
    assert {k for r in got for k in (r.doc_id, r.source_id)} == set(range(300))
    assert len(got) <= 2 * 2 * 300


def test_passages_repeated_inside(spark):
    """A passage twice in one of two documents: both of its places are reported, whichever document comes first."""
    chance = random.Random(6)
    for parts in (1, 4):
        rows, want = [], set()
        for k in range(12):
            twice = words(chance, 60)
            rows += [(2 * k, words(chance, 30) + twice + words(chance, 900) + twice), (2 * k + 1, words(chance, 7) + twice)]
            want |= {(2 * k, 30, 90), (2 * k, 990, 1050), (2 * k + 1, 7, 67)}
        docs = documents(spark, [(k, " ".join(w)) for k, w in rows]).repartition(parts)
        got = chaining.repeated_passages(docs).collect()
        assert ({(r.doc_id, r.start_word, r.end_word) for r in got} | {(r.source_id, r.source_start, r.source_end) for r in got}) == want


def test_passages_of_common_lines(spark):
    """Pairs that share a passage of lines which many other documents hold singly are reported in full."""
    chance = random.Random(8)
    lines = [words(chance, 11) for _ in range(30)]
    rows = [(100 + i, words(chance, 35) + lines[i % 30] + words(chance, 35)) for i in range(600)]
    want = set()
    for k in range(10):
        passage = sum(chance.sample(lines, 6), [])
        for key in (2 * k, 2 * k + 1):
            rows.append((key, words(chance, 20 + key) + passage + words(chance, 30)))
            want.add((key, 20 + key, 86 + key))
    chance.shuffle(rows)
    for parts in (1, 12):
        got = chaining.repeated_passages(documents(spark, [(k, " ".join(w)) for k, w in rows]).repartition(parts)).collect()
        assert want <= {(r.doc_id, r.start_word, r.end_word) for r in got} | {(r.source_id, r.source_start, r.source_end) for r in got}
        assert max(r.doc_id for r in got) < 100


def test_passages_recall(spark):
    """Passages of sixty words with words exchanged, where fifty or more remain from the first to the last that is the same."""
    chance = random.Random(10)
    rows, want = [], {}
    for k in range(300):
        passage = words(chance, 60)
        edits = (3, 6, 9)[k % 3]
        changed = edited(chance, passage, edits).split()
        same = [i for i in range(60) if passage[i] == changed[i]]
        rows += [(2 * k, words(chance, 20) + passage + words(chance, 20)), (2 * k + 1, words(chance, 40) + changed + words(chance, 10))]
        if same[-1] + 1 - same[0] >= 50:
            want.setdefault(edits, set()).add((2 * k + 1, 2 * k))
    got = {(r.doc_id, r.source_id) for r in chaining.repeated_passages(documents(spark, [(k, " ".join(w)) for k, w in rows])).collect()}
    shares = {edits: len(got & pairs) / len(pairs) for edits, pairs in want.items()}
    assert shares[3] >= 0.99 and shares[6] >= 0.98 and shares[9] >= 0.93


def test_passages_odd_rows(odd, empty):
    got = chaining.repeated_passages(odd).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(9, 8)}
    assert max(r.n_words for r in got) == len(LONG.split())
    assert chaining.repeated_passages(empty).count() == 0


def test_chain_is_best_by_brute_force():
    chance = np.random.default_rng(7)
    for _ in range(60):
        x, y = chance.integers(0, 60, 9), chance.integers(0, 60, 9)
        chain = chaining.chains(x, y)[0]

        def value(ids):
            steps = zip(ids, ids[1:])
            return 5 * len(ids) - sum(chaining.GAP_COST * (x[b] - x[a] + y[b] - y[a]) for a, b in steps)

        best = 0.0
        for mask in range(1, 1 << 9):
            ids = sorted((i for i in range(9) if mask >> i & 1), key=lambda i: x[i])
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(ids, ids[1:])):
                best = max(best, value(ids))
        assert abs(value(chain) - best) < 1e-9


def test_minimizers_are_shared_by_equal_stretches():
    chance = random.Random(9)
    shared = words(chance, chaining.WINDOW + 4)
    block = Block(pa.array([" ".join(words(chance, 50) + shared + words(chance, 7)), " ".join(words(chance, 3) + shared + words(chance, 90))]))
    hashes, index = chaining.minimizers(block)
    first, second = (set(hashes[block.row[index] == r].tolist()) for r in (0, 1))
    assert first & second


def test_single_matches_are_told_apart_by_the_words_beside_them():
    random = np.random.default_rng(7)
    codes = [random.integers(1, 4, size=n).astype(np.uint16) for n in (40, 9, 300, 70, 1200, 5)]
    codes += [random.integers(1, 60_000, size=400).astype(np.uint16) for _ in range(6)]
    codes[7][100:117] = codes[8][200:217]
    codes[9][100:130] = codes[10][10:40]
    codes[9][300:] = chaining.HIDDEN
    pairs, chained = [(0, 1), (2, 3), (4, 2), (5, 0), (7, 8), (9, 10), (9, 11), (6, 7)], []
    for a, b in pairs:
        places = np.column_stack([random.integers(0, len(codes[d]) - 4, size=30) for d in (a, b)])
        places[0] = (100, 200) if (a, b) == (7, 8) else (100, 10) if (a, b) == (9, 10) else places[0]
        chained.append(np.column_stack([np.arange(30), places]).astype("<i4"))
    row = np.repeat(np.arange(len(pairs)), 30)
    all_places = np.concatenate(chained).astype(np.int64)
    texts = [chaining._Texts([codes[pair[side]].tobytes() for pair in pairs]) for side in (0, 1)]
    wanted = ~chaining._hopeless(*texts, row, all_places[:, 1], all_places[:, 2])
    assert 20 < wanted.sum() < len(wanted) - 20

    def batch(**columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    docs, others = [a for a, _ in pairs], [b for _, b in pairs]
    beside, = chaining._beside_rows(iter([batch(doc=docs, other=others, chains=[c.tobytes() for c in chained],
                                                other_codes=[codes[b].tobytes() for b in others])]))
    assert {len(words) for words in beside.column("beside").to_pylist()} == {30 * 2 * 2 * chaining.BESIDE}
    found, = chaining._hopeful_rows(iter([beside.append_column("codes", pa.array([codes[a].tobytes() for a in docs]))]))
    got = {(r["doc"], r["other"]): r["chains"] for r in found.to_pylist()}
    for k, pair in enumerate(pairs):
        left = chained[k][wanted[row == k]]
        assert got.get(pair, b"") == left.tobytes() and (len(left) > 0) == (pair in got)


def test_pairs_of_lone_matches_do_not_meet_whole_texts(spark, monkeypatch):
    """Two texts that share five words, and two that share sixty: the first two are sorted out before texts are aligned."""
    texts = [[f"w{d}x{i}" for i in range(200)] for d in range(4)]
    texts[1][50:55] = texts[0][20:25] = ["here", "are", "five", "shared", "words"]
    texts[3][100:160] = texts[2][10:70]
    staged = {}
    keep = chaining.stage
    monkeypatch.setattr(chaining, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = chaining.repeated_passages(docs).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in found] == [(3, 100, 160, 2, 10)]
    assert staged["chains"].where("single").count() <= 1 and staged["hopeful"].count() == 0


def test_passages_are_found_with_few_rows_in_python_at_a_time(spark, monkeypatch):
    """Rows reach Python in small batches, as each may hold all words of two documents; the session's own number stays."""
    chance = random.Random(5)
    shared = words(chance, 60)
    rows = [(i, " ".join(words(chance, 55) + shared * (i in (3, 1100)))) for i in range(1200)]
    real = chaining._word_codes

    def watched(min_words):
        def run(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= 500
                    yield batch
            return real(min_words)(few())
        return run

    monkeypatch.setattr(chaining, "_word_codes", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = chaining.repeated_passages(documents(spark, rows).coalesce(1)).collect()
    assert {(r.source_id, r.doc_id) for r in got} == {(3, 1100)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_keys_are_linked_alike_in_small_batches():
    """Seeds and runs are linked among the same rows however many come at a time, and packed in parts."""
    chance, slices = random.Random(6), 40
    shared = words(chance, 60)
    texts = [" ".join(words(chance, 50) + shared * (i % 7 == 0)) for i in range(300)]
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(texts)], names=["doc", "text"])

    def unpacked(batches):
        found = Counter()
        largest = 0
        for packed in chaining._seed_rows(50, slices)(iter(batches)):
            largest = max(largest, sum(len(r["places"]) for r in packed.to_pylist()))
            for r in packed.to_pylist():
                docs = np.repeat(np.frombuffer(r["docs"], np.int64), chaining._numbers(r["counts"]))
                if r["matched"]:
                    others = np.repeat(np.frombuffer(r["others"], np.int64), chaining._numbers(r["counts"]))
                    half = len(r["places"]) // 2
                    found.update(zip([r["slice"]] * len(docs), docs.tolist(), others.tolist(), chaining._numbers(r["places"][:half]).tolist(),
                                     chaining._numbers(r["places"][half:]).tolist()))
                else:
                    found.update(zip([r["slice"]] * len(docs), np.frombuffer(r["keys"], np.uint64).tolist(), docs.tolist(),
                                     chaining._numbers(r["places"]).tolist()))
        return found, largest

    at_once, largest = unpacked([whole])
    assert at_once == unpacked([whole.slice(k, 20) for k in range(0, 300, 20)])[0]
    places = 4 * sum(2 if len(found) == 5 else 1 for found in at_once.elements())
    assert largest < places / 3
    cut = [(b.num_rows, full) for b, full in chaining._cut(iter([whole, whole.slice(0, 50)]), 130)]
    assert cut == [(130, True), (130, True), (40, False), (50, False)]
