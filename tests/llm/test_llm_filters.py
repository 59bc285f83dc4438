"""Surrogates, toxicity, URL lists, WARC packages and the pipeline."""

import base64
import datetime
import hashlib
import io
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dealscope.llm import surrogates, toxicity, url_lists, warc_zip
from llm_rows import ODD, documents

DAY = datetime.date(2024, 1, 1)


def replaced(spark, texts, key="secret"):
    got = surrogates.with_surrogates(documents(spark, list(enumerate(texts))), key).orderBy("doc_id").collect()
    return [r.text for r in got], [r.n_entities for r in got]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def test_surrogates_keep_format_and_coreference(spark):
    texts = ["write to ann.lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM", "call +1 (499) 555-6503, or (499) 555-6503 now",
             "from 96.153.118.61.", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "4111 1111 1111 1111 and 4111111111111111",
             "ssn 123-45-6789", "Mary Smith and John Smith met Dr. Smith", "Мария Иванова", "nothing 12 of 3.4.5 here Mary"]
    got, counts = replaced(spark, texts)
    assert counts == [2, 2, 1, 1, 2, 1, 3, 1, 0]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    for i in (0, 1, 3, 4, 5):
        assert shape(got[i]).replace("a", "0") == shape(texts[i]).replace("a", "0") and got[i] != texts[i]
    one, two = re.findall(r"\S+@\S+", got[0])
    assert one.upper() == two and one.endswith(".com") and one != "ann.lee@mail.example.com"
    assert len(set(re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[1]))) == 1 and "+1 (" in got[1]
    octets = re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", got[2]).groups()
    assert all(int(o) < 256 for o in octets) and got[2] != texts[2]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3])
    cards = re.findall(r"[\d ]{15,}\d", got[4])
    assert len({c.replace(" ", "") for c in cards}) == 1 and luhn(cards[0].replace(" ", "")) == 0
    names = re.fullmatch(r"(\w+) (\w+) and (\w+) (\w+) met Dr\. (\w+)", got[6]).groups()
    assert names[0] in surrogates.GIVEN_NAMES["female latin"] and names[2] in surrogates.GIVEN_NAMES["male latin"]
    assert names[1] == names[3] == names[4] != "Smith" and names[0] != "Mary"
    first, last = got[7].split()
    assert first in surrogates.GIVEN_NAMES["female cyrillic"] and re.fullmatch("[А-Я][а-я]+", last)
    assert got[8] == texts[8]
    assert replaced(spark, texts, "other")[0] != got and replaced(spark, texts)[0] == got


def test_surrogates_long_keys_and_plain_phones(spark):
    """Keys of any length are masked, and phone numbers without separators, as the same number with them."""
    token = "eyJ" + "aB3x_-Zq9" * 80
    late = "k" * 150 + "7"
    texts = [f"token {token}.", f"({late})", f"{token[:-2]}-\u00e9", "call +14155552671 now", "call +1 415 555 2671 now", "+442079460123", "+1234567"]
    new = [r.text for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
           .transform(lambda d: surrogates.with_surrogates(d, "k")).orderBy("doc_id").collect()]
    assert [len(n) for n in new] == [len(t) for t in texts]
    assert token not in new[0] and late not in new[1] and token[:-2] not in new[2]
    assert re.fullmatch(r"call \+1\d{10} now", new[3]) and new[3] != texts[3]
    assert re.sub(r"\D", "", new[3]) == re.sub(r"\D", "", new[4])
    assert re.fullmatch(r"\+44\d{10}", new[5]) and new[5] != texts[5]
    assert new[6] == texts[6]


def test_surrogates_are_distinct(spark):
    texts = [f"{i:03d}-55-{i:04d}" for i in range(400)] + [f"10.0.{i // 256}.{i % 256}" for i in range(400)]
    got, _ = replaced(spark, texts)
    assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_surrogates_that_collide_are_made_anew(spark):
    """Surnames of one letter leave few surrogates, so many are other entities at first."""
    texts = [f"Mary {c}o" for c in "ABCDEFGHIJKLMNOPQRSTUVW"] + [f"Mary B{c}" for c in "abcdefghij"]
    got, _ = replaced(spark, texts)
    assert len(set(got)) == len(set(texts))
    assert not {g.split()[1] for g in got} & {t.split()[1] for t in texts}


def test_surrogates_odd_rows(odd, empty):
    got = surrogates.with_surrogates(odd, "k")
    assert got.columns == [*odd.columns, "n_entities"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(ODD)
    assert surrogates.with_surrogates(empty, "k").count() == 0


def test_surrogates_run_without_python(sample):
    plan = surrogates.with_surrogates(sample, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_surrogates_leave_nothing(spark, sample):
    both = surrogates.with_surrogates(sample, "k").withColumnRenamed("text", "new").join(sample.select("doc_id", "text"), "doc_id").collect()
    left = 0
    for r in both:
        found = re.findall(r"[\w.]+@[\w.]+\.com|\b[0-9a-f]{40}\b|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b", r.text)
        left += sum(x in r.new for x in found)
        assert bool(found) == (r.n_entities > 0) and (found or r.new == r.text)
    assert left == 0


def test_chain_on_held_out_labels(spark, folder):
    """Trained on even documents, the chain is right about odd ones."""
    big = folder.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    hits = sum(r.rejected and r.toxic for r in got)
    assert hits / sum(r.toxic for r in got) >= 0.85
    assert sum(r.rejected and not r.toxic for r in got) <= 0.01 * len(got)


def test_chain_uses_earlier_categories():
    """A later category that only follows from an earlier one is learnt through the chain."""
    chance = np.random.default_rng(3)
    hashes, offsets, labels = [], [0], []
    for _ in range(600):
        bad = chance.random() < 0.3
        own = np.unique(np.concatenate([chance.integers(100, 160, 8), [chance.integers(10)] if bad else []])).astype(np.uint64)
        hashes.append(own)
        offsets.append(offsets[-1] + len(own))
        labels.append((bad, bad, bad and chance.random() < 0.9))
    chain = toxicity.fit_chain(np.concatenate(hashes), np.array(offsets), np.arange(600) % 3, np.array(labels, int), ("a", "b", "c"))
    assert chain.models[1].chained[0] > 0 and len(chain.models[2].chained) == 2
    chances = chain.probabilities(np.concatenate(hashes), np.array(offsets))
    assert ((chances[:, 1] > 0.5) == np.array(labels)[:, 1]).mean() > 0.98


def test_toxicity_odd_rows(spark, odd, empty):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (4, 1, 1), (5, 0, 1), (6, 1, 0), (99, 1, 1)], schema)
    got = toxicity.toxicity(odd, labels)
    assert Counter(r.doc_id for r in got.collect()) == Counter(k for k, _ in ODD)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    none = spark.createDataFrame([], schema)
    assert toxicity.toxicity(odd, none).where("rejected").count() == 0
    assert Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(odd, none).collect()) == Counter(ODD)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0


def test_url_lists(spark):
    entries = spark.createDataFrame([("example.com", "add", DAY), ("example.com", "remove", DAY.replace(month=3)), ("example.com", "add", DAY.replace(month=5)),
                                     ("a.example.org/x", "add", DAY), ("b.org", "add", DAY), ("b.org", "remove", DAY), (None, "add", DAY),
                                     ("c.org", "drop", DAY), ("c.org", "add", None)], "pattern string, action string, listed_on date")
    cases = [("http://www.example.com/p", 1, True), ("http://www.example.com/p", 3, False), ("HTTP://u:p@EXAMPLE.com:80?q", 6, True),
             ("http://notexample.com/", 2, False), ("https://a.example.org/x/y#z", 2, True), ("https://a.example.org/xy", 2, False),
             ("http://b.org/", 2, False), ("http://c.org/", 2, False), (None, 2, False), ("nonsense", 2, False), ("http:///x", 2, False),
             ("http://example.com./", 6, True), ("http://example.com", None, False)]
    captures = spark.createDataFrame([(i, u, DAY.replace(month=m) if m else None) for i, (u, m, _) in enumerate(cases)],
                                     "pattern int, url string, fetched_on date").withColumn("valid_to", F.lit(1))
    got = url_lists.listed_captures(captures, entries).orderBy("pattern").collect()
    assert [r.listed for r in got] == [want for *_, want in cases]
    assert got[0].first_pattern == "example.com" and got[0].listed_since == DAY
    none = url_lists.listed_captures(captures.where("false"), entries)
    assert none.count() == 0 and url_lists.listed_captures(captures, entries.where("false")).where("listed").count() == 0


def test_url_lists_long_histories_and_hot_hosts(spark):
    days = [DAY + datetime.timedelta(days=i) for i in range(600)]
    entries = spark.createDataFrame([("hot.com", "add" if i % 2 == 0 else "remove", d) for i, d in enumerate(days)],
                                    "pattern string, action string, listed_on date")
    captures = spark.createDataFrame([(i, "http://hot.com/" + "x" * (i % 3), days[i % 600]) for i in range(5000)], "n int, url string, fetched_on date")
    got = url_lists.listed_captures(captures, entries).collect()
    assert len(got) == 5000 and all(r.listed == (r.n % 600 % 2 == 0) for r in got)


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (None, "http://c", "<p>x</p>"), (4, None, None),
         (5, "bad\r\nurl", ""), (6, "http://é", "é日" * 5000), (7, "http://d", "y" * 300_000), (None, None, "only\r\n\r\nmine")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("digest", "_key", "first", "payload")})


def test_warc_round_trip(spark):
    got = warc_zip.round_trip(pages(spark, PAGES)).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert r.record_type in ("response", "revisit")
        if r.payload is not None:
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
    digest = base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    same = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.payload_digest == digest]
    assert Counter(same) == Counter([(1, "response", None, 8), (2, "revisit", 1, 8), (2, "revisit", 1, 8), (None, "revisit", 1, 8)])
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0} == {(4, "response", None), (5, "revisit", 4)}
    assert Counter(bytes(r.payload).decode() for r in got if r.payload is not None) == Counter({(h or ""): 1 for *_, h in PAGES})
    assert warc_zip.round_trip(pages(spark, PAGES).where("false")).count() == 0
    large = warc_zip.round_trip(pages(spark, PAGES), revisit_bytes=100).collect()
    assert all(r.record_type == "response" for r in large)


def test_warc_many_small_packages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"text {i}" * 50) for i in range(300)]
    got = warc_zip.round_trip(pages(spark, rows), folder=str(tmp_path), limit=2000).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in got) == Counter((i, h) for i, _, h in rows)
    assert len(list(tmp_path.iterdir())) > 20


def package(members, comment=b"", wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            with z.open(name, "w", force_zip64=wide) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


def test_zip_directories(spark, tmp_path):
    """A package without index and with a comment; one whose directory holds ZIP64 records."""
    raw = [warc_zip.record(i, f"http://x/{i}", b"p%d" % i, base64.b32encode(hashlib.sha1(b"p%d" % i).digest()).decode(), None, False) for i in range(5)]
    plain = package([("other.txt", b"PK\x05\x06 decoy"), ("archive/own.warc.gz", b"".join(raw))], b"a comment PK\x05\x06", True)
    (tmp_path / "a.zip").write_bytes(plain)
    bare = package([("archive/own.warc.gz", b"".join(raw))])
    end = bare.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack_from("<HII", bare, end + 10)
    entry_at = bare.find(b"PK\x01\x02")
    central = bytearray(bare[entry_at:end])
    packed, unpacked = struct.unpack_from("<II", central, 20)
    header, = struct.unpack_from("<I", central, 42)
    struct.pack_into("<II", central, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", central, 42, 0xFFFFFFFF)
    extra = struct.pack("<HHQQQ", 1, 24, unpacked, packed, header)
    struct.pack_into("<H", central, 30, len(extra))
    central += extra
    record64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(central), offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, offset + len(central), 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "b.zip").write_bytes(bare[:entry_at] + bytes(central) + record64 + locator + tail)
    for name in ("a.zip", "b.zip"):
        found = warc_zip.places(spark.createDataFrame([(str(tmp_path / name),)], "uri string"))
        got = warc_zip.records(found).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, b"p%d" % i) for i in range(5)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/own.warc.gz", raw[0])
    with pa.OSFile(str(tmp_path / "c.zip")) as source, pytest.raises(ValueError, match="compressed"):
        warc_zip.data_start(source, warc_zip.members(source)[0])


def test_pipeline_small(spark, folder):
    """Each stage's decisions against brute force on its own input."""
    import corpus_pipeline
    from test_llm_exact import check_packed, plain
    from test_llm_near import classes

    small = folder.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    columns, before = docs.columns, docs.collect()
    for name, function in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(function(spark, docs, small), "test")
        after = out.collect()
        if name != "best-fit packing":
            assert out.columns == columns
            kept = {r.doc_id: r for r in after}
            assert len(kept) == len(after)
        if name == "toxicity":
            gone = [r.doc_id for r in before if r.doc_id not in kept]
            assert gone and sum(labels.get(k, 1) == 0 for k in gone) <= 1
        elif name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(plain(r.text), r.doc_id)
            assert set(kept) == set(first.values())
        elif name == "n-gram Jaccard join":
            assert set(kept) == set(classes([(r.doc_id, r.text) for r in before]))
        elif name == "PII":
            assert set(kept) == {r.doc_id for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            check_packed(after, [(r.doc_id, r.text) for r in before])
        docs, before = out, after


def test_all_operators_are_registered():
    names = [name for name in entry.queries() if re.match(r"op\d+_", name)]
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
