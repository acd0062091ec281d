"""Pages about an entity, feeds, paging and search over what the tables name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.sources.events import micros

DAY_US = 86_400_000_000


def top(df: DataFrame, keys: list[str], item: str, n: str, k: int) -> DataFrame:
    """The k items with the largest n of each key; ties by item."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), F.col(item)))
    return df.withColumn("place", place).where(F.col("place") <= k)


def page(events: DataFrame, entity: Column, now_us: int, sections: dict[str, tuple[Column, int, int]], latest: int = 20) -> DataFrame:
    """Long rows (entity, section, place, item, n): totals, the last day, first and last time, the top items of each
    section (name: expression, days, how many), and the latest events. One scan feeds them all; entities are pages in parallel.
    """
    us = micros("event_ts")
    e = events.select(entity.alias("entity"), us.alias("us"), "event_id", *[c.alias(f"s_{k}") for k, (c, _, _) in sections.items()]).where("entity IS NOT NULL AND entity <> ''")
    totals = e.groupBy("entity").agg(F.count("*").alias("total"), F.count_if(F.col("us") >= now_us - DAY_US).alias("day"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    facts = totals.select("entity", F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("n")) for c in ("total", "day", "first_us", "last_us")])).alias("x"))
    parts = [facts.select("entity", "x.section", F.lit(1).alias("place"), F.lit(None).cast("string").alias("item"), "x.n")]
    for name, (_, days, k) in sections.items():
        counts = e.where((F.col("us") >= now_us - days * DAY_US) & F.col(f"s_{name}").isNotNull()).groupBy("entity", F.col(f"s_{name}").alias("item")).agg(F.count("*").alias("n"))
        parts.append(top(counts, ["entity"], "item", "n", k).select("entity", F.lit(name).alias("section"), "place", "item", "n"))
    newest = e.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("us"), "event_id"))).where(F.col("place") <= latest)
    parts.append(newest.select("entity", F.lit("latest").alias("section"), "place", F.col("event_id").cast("string").alias("item"), F.col("us").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def paged(df: DataFrame, order: list[Column], limit: int = 1000, offset: int = 0, most: int = 5000) -> DataFrame:
    """One page of df by a total order; a limit over the most a page may hold is lowered to it."""
    return df.orderBy(*order).offset(offset).limit(min(limit, most))


def capped(df: DataFrame, order: list[Column], cap: int = 5000) -> DataFrame:
    """The first rows as strings, and whether there are more: one row more than the cap is looked at."""
    more = df.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
    return df.orderBy(*order).limit(cap).select(*[F.col(c).cast("string") for c in df.columns]).crossJoin(F.broadcast(more))  # one row


def search(tables: dict[str, tuple[DataFrame, Column]], text: str, cap: int = 20) -> DataFrame:
    """(kind, name, total): names that hold the text, in any case, cap of each kind, with how many there are."""
    parts = []
    for kind, (df, name) in tables.items():
        hit = df.select(name.alias("name")).where(F.contains(F.lower("name"), F.lit(text.lower()))).distinct()
        total = hit.agg(F.count("*").alias("total"))
        parts.append(hit.orderBy("name").limit(cap).crossJoin(F.broadcast(total)).select(F.lit(kind).alias("kind"), "name", "total"))  # one row
    return reduce(DataFrame.unionByName, parts)


def batch_after(df: DataFrame, ts_us: str, key: str, watermark_us: int, cap: int = 5000) -> tuple[DataFrame, int]:
    """The first rows after a watermark, in order, and the next watermark: the last time, less one if the batch is full,
    so that rows of that very time which it left out are read again."""
    rows = df.where(F.col(ts_us) > watermark_us).orderBy(ts_us, key).limit(cap)
    told = rows.agg(F.max(ts_us).alias("last"), F.count("*").alias("n")).first()
    return rows, watermark_us if not told["n"] else told["last"] - (told["n"] == cap)
