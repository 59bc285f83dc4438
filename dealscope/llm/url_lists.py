"""Dated URL lists applied to captures as of their fetch time.

Entries (pattern, action, date) become intervals in which a pattern is listed: from an "add" to the next entry of the
pattern. A pattern is a domain (covering its subdomains) or a host with the start of a path. A capture is looked up
under every pattern that could cover it; interval and capture meet on the pattern and on a stretch of time, so
a pattern with a long history or with very many captures is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealscope.llm.tables import join_hot
from dealscope.session import stage

#: Length of the stretches of time that captures and intervals meet in.
STRETCH_DAYS = 64

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def patterns_of(url: Column) -> Column:
    """Every pattern that covers the URL: the domains its host is in (two labels at least, or the only one), and the
    host with each start of the path, segment by segment. Empty for a null URL or one without host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."))
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    starts = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(host, F.lit("")) == "", none).otherwise(F.concat(domains, F.coalesce(starts, none)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from entries (pattern, action, listed_on); valid_to is exclusive, null while open.

    Of entries of one pattern and date, a "remove" wins over an "add". Entries with a null pattern or date, or with
    another action, are passed over; repeated entries count once.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_on").isNotNull() & F.col("action").isin("add", "remove"))
    daily = known.groupBy("pattern", "listed_on").agg(F.bool_or(F.col("action") == "remove").alias("removed"))
    order = Window.partitionBy("pattern").orderBy("listed_on")
    return (daily.withColumn("valid_to", F.lead("listed_on").over(order)).where("not removed")
            .select("pattern", F.col("listed_on").alias("valid_from"), "valid_to"))


def _stretch(moment: Column) -> Column:
    return F.floor(F.unix_date(moment.cast("date")) / STRETCH_DAYS).cast("int")


def listed_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with n_active, listed, first_pattern and listed_since, as of each capture's fetch time.

    n_active counts the patterns listed then, first_pattern is the smallest of them in string order and listed_since the
    earliest start among all. A null or unusual URL, or a null fetch time, is listed under nothing. Captures with equal URL and time
    are looked up once; repeated rows stay. Columns of ``captures`` with the names of the results are overwritten.
    """
    columns = [name for name in captures.columns if name not in ("n_active", "listed", "first_pattern", "listed_since")]
    # Names of our own, so that other columns of the captures can be called anything.
    rows = captures.select(*[F.col(name) for name in columns], F.col(url).alias("_url"), F.col(fetched).alias("_time"))
    looked_up = rows.where(F.col("_time").isNotNull() & (host_of(F.col("_url")) != "")).groupBy("_url", "_time").agg(F.count("*").alias("_rows"))
    looked_up = stage(looked_up, "lookups")
    # One row: the time that the captures span, beyond which intervals need not be laid out.
    first, last = looked_up.agg(F.min(_stretch(F.col("_time"))), F.max(_stretch(F.col("_time")))).first()
    keys = (looked_up.select("_url", "_time", F.explode(F.array_distinct(patterns_of(F.col("_url")))).alias("pattern"))
            .withColumn("_stretch", _stretch(F.col("_time"))))
    begin = F.greatest(_stretch(F.col("valid_from")), F.lit(first))
    end = F.least(F.coalesce(_stretch(F.col("valid_to")), F.lit(last)), F.lit(last))
    intervals = (validity_intervals(entries).where(begin <= end)
                 .withColumn("_stretch", F.explode(F.sequence(begin, end))))
    active = (keys.join(intervals, ["pattern", "_stretch"])
              .where((F.col("valid_from") <= F.col("_time")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to"))))
              .groupBy("_url", "_time").agg(F.count("*").alias("n_active"), F.min("pattern").alias("first_pattern"),
                                            F.min("valid_from").alias("listed_since")))
    found = stage(looked_up.join(active, ["_url", "_time"]), "listed")
    joined = join_hot(rows, found, ["_url", "_time"], "_rows", looked_up.agg(F.sum("_rows")).first()[0] or 0)
    return joined.select(*columns, F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("n_active").isNotNull().alias("listed"),
                         "first_pattern", "listed_since")
