"""The operators of this folder as queries over the given tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscope.llm.bpe import bpe_round_trip
from dealscope.llm.chaining import repeated_passages
from dealscope.llm.exact_dedup import exact_duplicates
from dealscope.llm.hard_negatives import hard_negatives
from dealscope.llm.language_model import lattice_scores
from dealscope.llm.ngram_join import near_duplicates
from dealscope.llm.packing import pack_documents
from dealscope.llm.ranked_search import ranked_documents
from dealscope.llm.sketch import fingerprints
from dealscope.llm.surrogates import with_surrogates
from dealscope.llm.tables import read
from dealscope.llm.toxicity import toxicity
from dealscope.llm.url_lists import listed_captures, patterns_of
from dealscope.llm.warc_zip import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: The secret of the surrogates; a real one comes from the caller.
SURROGATE_KEY = "sample key"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_pii_surrogates(spark, folder):
    return with_surrogates(read(spark, folder, "documents"), SURROGATE_KEY)


def captures_and_entries(spark, folder):
    """The pages with a fetch date, and a dated list over the patterns that occur in them.

    The tables hold neither; both follow from the pages by rule: the date from page_id, and for each pattern an
    entry in one of five cases, its removal in one of ten, and its return in one of twenty.
    """
    pages = read(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    number = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    patterns = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct().withColumn("n", number)
    first = F.date_add(F.lit("2023-10-01").cast("date"), F.col("n") % 400)
    steps = F.array(*[F.struct(F.lit(action).alias("action"), date.alias("listed_on"), F.lit(every).alias("every"))
                      for action, date, every in (("add", first, 5), ("remove", F.date_add(first, 30 + F.col("n") % 90), 10),
                                                  ("add", F.date_add(first, 75 + F.col("n") % 90), 20))])
    entries = patterns.select("pattern", "n", F.explode(steps).alias("s")).where(F.col("n") % F.col("s.every") == 0)
    return captures, entries.select("pattern", "s.action", "s.listed_on")


@query
def op2_temporal_url_lists(spark, folder):
    return listed_captures(*captures_and_entries(spark, folder))


ORACLE_SQL["op2_temporal_url_lists"] = r"""
with captures as (
 select page_id, url, date '2024-01-01' + cast(page_id % 365 as integer) as fetched_on,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') as host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as path
 from pages),
keys as (
 select page_id, fetched_on, unnest(list_distinct(list_concat(
  list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
  list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/'))))) as pattern
 from captures where host <> ''),
numbered as (select pattern, cast('0x' || substr(md5(pattern), 1, 6) as integer) as n from (select distinct pattern from keys)),
dated as (select *, date '2023-10-01' + n % 400 as first_on from numbered),
entries as (
 select pattern, 'add' as action, first_on as listed_on from dated where n % 5 = 0
 union all select pattern, 'remove', first_on + 30 + n % 90 from dated where n % 10 = 0
 union all select pattern, 'add', first_on + 75 + n % 90 from dated where n % 20 = 0),
daily as (select pattern, listed_on, bool_or(action = 'remove') as removed from entries group by all),
intervals as (select * from (
 select pattern, listed_on as valid_from, lead(listed_on) over (partition by pattern order by listed_on) as valid_to, removed
 from daily) where not removed),
active as (
 select page_id, count(*) as n_active, min(pattern) as first_pattern, min(valid_from) as listed_since
 from keys join intervals using (pattern)
 where valid_from <= fetched_on and (valid_to is null or fetched_on < valid_to) group by page_id)
select page_id, url, fetched_on, coalesce(n_active, 0) as n_active, n_active is not null as listed, first_pattern, listed_since
from captures left join active using (page_id)
"""


@query
def op3_exact_dedup(spark, folder):
    return exact_duplicates(read(spark, folder, "documents"))


ORACLE_SQL["op3_exact_dedup"] = r"""
with plain as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
 doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
from plain window w as (partition by body)
"""


@query
def op4_best_fit_packing(spark, folder):
    return pack_documents(read(spark, folder, "documents"))


@query
def op5_collinear_chaining(spark, folder):
    return repeated_passages(read(spark, folder, "documents"))


@query
def op6_segment_tree_bpe(spark, folder):
    return bpe_round_trip(read(spark, folder, "documents"))


@query
def op7_classifier_chain(spark, folder):
    return toxicity(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("content")


@query
def op8_warc_zip(spark, folder):
    read_back = round_trip(read(spark, folder, "pages"))
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op8_warc_zip"] = r"""
with payloads as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as digest from pages),
firsts as (select *, min(page_id) over (partition by digest) as first_id from payloads)
select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((cast('0x' || substr(digest, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
 case when page_id = first_id then 'response' else 'revisit' end as record_type,
 case when page_id <> first_id then first_id end as refers_to
from firsts
"""


@query
def op9_ngram_jaccard_join(spark, folder):
    return near_duplicates(read(spark, folder, "documents"))


@query
def op10_threshold_sketch(spark, folder):
    return fingerprints(read(spark, folder, "documents"))


@query
def op12_subword_lattice(spark, folder):
    return lattice_scores(read(spark, folder, "documents"))


@query
def op13_range_maximum_search(spark, folder):
    return ranked_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLE_SQL["op13_range_maximum_search"] = r"""
with words as (
 select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
held as (select doc_id, terms, cast(len(terms) as bigint) as n from words where len(terms) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as all_terms from held),
tfs as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from held) group by all),
asked as (
 select item_id, term, count(*) as repeats from (select item_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
 from (select term, count(*) as df from tfs group by term), total),
scores as (
 select item_id, doc_id, cast(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms)))) as bigint) as score
 from asked join weights using (term) join tfs using (term), total group by item_id, doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


@query
def op11_str_rtree_negatives(spark, folder):
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=moved)


ORACLE_SQL["op11_str_rtree_negatives"] = r"""
with vectors as (
 select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
 from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
 select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
  cast(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
 from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select * from scores where same
 qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id,
 cast(row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as integer) as rank,
 n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on p.anchor_id = n.anchor_id and not n.same
where 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""
