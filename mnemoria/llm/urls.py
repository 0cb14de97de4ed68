"""Operator 5: URL filters by a temporal list join.

Block lists change: an entry is added on one day and removed on another. Dated entries become
validity intervals, and every capture is held against the entries that were active when it was
fetched, not against today's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty for what is no absolute URL."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def lookup_keys(url: Column) -> Column:
    """Every pattern that covers a URL: the host and its parent domains, the folders, the page itself."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    # "/a/b/c" has the folders "/", "/a/" and "/a/b/".
    folders = F.when((host == "") | (path == ""), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(host, F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    page = F.when((host == "") | (path == ""), F.array().cast("array<string>")).otherwise(F.array(F.concat(host, path)))
    return F.array_distinct(F.concat(domains, folders, page))


def month(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def validity(entries: DataFrame) -> DataFrame:
    """``(pattern, category, valid_from, valid_to)`` from ``(pattern, category, action, at)``.

    An ``add`` holds until the next entry of its pattern and category, the last one for ever. Of
    entries of one instant an ``add`` wins. Entries are ordered inside months, and the months of a
    pattern are chained by their first entry, so a pattern with very many entries is sorted in parts.
    """
    clean = entries.where("pattern is not null and at is not null and action in ('add', 'remove')").select("pattern", F.coalesce("category", F.lit("")).alias("category"), "action", "at")
    # One action for each instant: 'add' sorts before 'remove'.
    steps = clean.groupBy("pattern", "category", "at", month(F.col("at")).alias("month")).agg(F.min("action").alias("action"))
    firsts = steps.groupBy("pattern", "category", "month").agg(F.min("at").alias("first_at"))
    chained = firsts.select("pattern", "category", "month", F.lead("first_at").over(Window.partitionBy("pattern", "category").orderBy("month")).alias("next_month_at"))
    inside = steps.withColumn("next_at", F.lead("at").over(Window.partitionBy("pattern", "category", "month").orderBy("at")))
    joined = inside.join(chained, ["pattern", "category", "month"])
    return joined.where("action = 'add'").select("pattern", "category", F.col("at").alias("valid_from"), F.coalesce("next_at", "next_month_at").alias("valid_to"))


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(id, fetched_at, url, pattern, category)``: each entry that covers a capture and was active then.

    An as-of join: equal pattern and month, then the interval. Intervals are listed under the months
    they cover up to the last capture, so a pattern with many entries meets a capture with those of
    one month only; a hot host is an ordinary skewed join that Spark splits.
    """
    horizon = captures.agg(F.max(month(F.col("fetched_at"))).alias("last"), F.min(month(F.col("fetched_at"))).alias("first")).first()
    if horizon["last"] is None:
        return captures.sparkSession.createDataFrame([], f"id {captures.schema['id'].dataType.simpleString()}, fetched_at timestamp, url string, pattern string, category string")
    held = validity(entries)
    start = F.greatest(month(F.col("valid_from")), F.lit(horizon["first"]))
    stop = F.least(F.coalesce(month(F.col("valid_to")), F.lit(horizon["last"])), F.lit(horizon["last"]))
    listed = held.where(start <= stop).select("*", F.explode(F.sequence(start, stop)).alias("month"))
    keyed = captures.where("fetched_at is not null and url is not null").select("id", "fetched_at", "url", month(F.col("fetched_at")).alias("month"), F.explode(lookup_keys(F.col("url"))).alias("pattern"))
    met = keyed.join(listed, ["pattern", "month"])
    return met.where("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)").select("id", "fetched_at", "url", "pattern", "category")


def temporal_url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, fetched_at, url, n_active, pattern, blocked``: the verdict at fetch time of every capture.

    ``captures(id, url, fetched_at)``, ``entries(pattern, category, action, at)``; ``pattern`` in the
    result is the smallest active one. Null or relative URLs and captures without a time match
    nothing; entries lacking a pattern or time, or with another action, are ignored; rows that
    repeat an id, time and URL are one capture, and URLs of one id and time are captures of their own; a very long URL is
    taken whole, with a key for each of its folders; empty tables give what follows from that; other columns are ignored.
    """
    matches = active_entries(captures, entries)
    every = captures.select("id", "fetched_at", "url", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("category"))
    both = every.unionByName(matches)
    # One row for each capture, match and category, whatever the number of repeated rows.
    found = both.groupBy("id", "fetched_at", "url").agg(F.size(F.collect_set(F.when(F.col("pattern").isNotNull(), F.struct("pattern", "category")))).cast("long").alias("n_active"), F.min("pattern").alias("pattern"))
    return found.withColumn("blocked", F.col("n_active") > 0)
