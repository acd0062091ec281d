"""Operator 10, URL filters by a temporal list join (native).

A list is a history of dated entries: at a time, a pattern enters a category or leaves it. Of each pattern and
category the entries in order of time become validity intervals, open at the end if nothing follows. A pattern
is a host, a domain above it, or a host with a path prefix of whole segments; each capture looks its own hosts,
domains and prefixes up among the intervals, and the ones that hold its fetch time are active. So each capture is
judged by the list as it stood when it was fetched. Of the active entries the longest pattern decides; of equally
long ones `allow` does, else the first category by name. Without an active entry, or with `allow`, a capture stays.

The join is on the pattern, with the interval as condition; intervals of one pattern and category don't overlap,
so a capture meets at most one for each. Up to BROADCAST_INTERVALS of them are broadcast, and no capture moves
before its matches are found; beyond, they are joined by a shuffle, whose large partitions adaptive execution splits.

Edge cases: a null or empty url, or one without a host, has no patterns, and stays; a null fetch time has no active
entries; captures that repeat are judged alike, each with its own row; entries without pattern, category or time
are left out; of entries of one pattern, category and time a removal wins; empty tables give empty results; only the
columns named are read, others don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import cut

ALLOW, ADD, REMOVE = "allow", "add", "remove"
BROADCAST_INTERVALS = 500_000
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, AUTHORITY + r"(?:[^/?#@]*@)?([^/?#:]*)", 1))


def patterns_of(url: Column) -> Column:
    """What a list may name a url by: its host and the domains above it of two or more labels, and its path prefixes."""
    host, path = host_of(url), F.regexp_extract(url, AUTHORITY + r"[^/?#]*([^?#]*)", 1)
    labels, parts = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) of entries (pattern, category, at, action); until is null while it lasts."""
    known = entries.where("pattern IS NOT NULL AND category IS NOT NULL AND at IS NOT NULL")
    once = known.groupBy("pattern", "category", "at").agg(F.max("action").alias("action"))  # 'remove' comes after 'add'
    until = F.lead("at").over(Window.partitionBy("pattern", "category").orderBy("at"))
    return once.withColumn("until", until).where(F.col("action") == ADD).select("pattern", "category", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched", broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """page_id, url, fetched, kept, n_active, and the deciding entry (pattern, category, since) per row of captures."""
    given = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(fetched_col).alias("fetched"))
    valid = cut(intervals(entries))
    few = valid.limit(broadcast_intervals + 1).count() <= broadcast_intervals
    asked = given.where("fetched IS NOT NULL").select("page_id", "url", "fetched", F.explode(F.array_distinct(patterns_of(F.col("url")))).alias("pattern"))
    active = asked.join(F.broadcast(valid) if few else valid, "pattern").where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    order = F.struct(-F.length("pattern"), F.when(F.col("category") == ALLOW, 0).otherwise(1), F.col("category"), F.col("pattern"))
    # Equal captures find equal entries, so their matches count once for each entry.
    found = active.groupBy("page_id", "url", "fetched", "pattern", "category", "since").agg(F.lit(1).alias("one"))
    found = found.groupBy(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("fetched").alias("_at")).agg(F.count("*").alias("n_active"), F.min_by(F.struct("pattern", "category", "since"), order).alias("by"))
    same = given["page_id"].eqNullSafe(found["_id"]) & (given["url"] == found["_url"]) & (given["fetched"] == found["_at"])
    out = given.join(found, same, "left")
    return out.select(
        "page_id", "url", "fetched",
        F.coalesce(F.col("by.category") == ALLOW, F.lit(True)).alias("kept"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("by.pattern").alias("pattern"), F.col("by.category").alias("category"), F.col("by.since").alias("since"),
    )


def keep_allowed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """captures without those that the list, as it stood when they were fetched, keeps out."""
    out = judge(captures, entries, id_col, url_col, fetched_col).where("NOT kept").select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("fetched").alias("_at")).distinct()
    same = captures[id_col].eqNullSafe(out["_id"]) & (captures[url_col] == out["_url"]) & (captures[fetched_col] == out["_at"])
    return captures.join(out, same, "left_anti")
