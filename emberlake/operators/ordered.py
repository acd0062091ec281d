"""Orders over whole tables without a task that holds all: ranges of rows, sorted within, and what each hands on to the next.

Rows are range-sorted and written with the number of their range, so that all steps see the same ranges. A range
hands on a few values (counts, last rows), one row a range, over which a window may run.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder that driver and executors share and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    to = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df with _range, the number of the range of the order that a row is in; written."""
    return shared(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place in the whole order, from 1; the order has to be total for places that don't change."""
    dealt = ranged(df, *order)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = sizes.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, within + F.col("_before")).drop("_range", "_before")


def handed_on(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """(_range, keys, values) for each range whose first key goes on from earlier ranges: what these hand on to it.

    values: name: (column, how), where how is `first` or `last` (that of the first or last row where it isn't null), `max`, `sum` or `count`. Only the first and the
    last key of a range can cross its borders, so this is a row or two a range.
    """
    key = F.struct(*keys)
    ends = df.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    at_ends = df.join(F.broadcast(ends), "_range").where((key == F.col("_first")) | (key == F.col("_last")))
    at = F.struct(*order)
    how = {"first": lambda c: F.min_by(c, F.when(c.isNotNull(), at)), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "max": F.max, "sum": F.sum, "count": lambda c: F.count("*")}
    told = at_ends.groupBy("_range", *keys).agg(*[how[h](c).alias(n) for n, (c, h) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    on = {"first": lambda n: F.first(n, ignorenulls=True).over(before), "last": lambda n: F.last(n, ignorenulls=True).over(before), "max": lambda n: F.max(n).over(before), "sum": lambda n: F.sum(n).over(before), "count": lambda n: F.sum(n).over(before)}
    return told.select("_range", *keys, *[on[h](n).alias(n) for n, (_, h) in values.items()])


def handed(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """df (ranged) with what earlier ranges hand on to each row's key, null where the key begins in the row's range."""
    on = handed_on(df, keys, order, values).withColumnsRenamed({c: f"{c}__" for c in ("_range", *keys)})
    same = [F.col("_range") == F.col("_range__"), *[F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]]
    return df.join(F.broadcast(on), same, "left").drop(*on.columns[: 1 + len(keys)])


def sequential(events: DataFrame, keys: list[str], number: str, order: list[str], least: int = 12) -> DataFrame:
    """Adjacent ids walked up or down, so many in a row; once until an id isn't adjacent. A turn starts anew at two ids.

    The order within a key is dealt to ranges, so one actor may have all rows. Three times the ranges hand on what
    their first key needs: the last number, the last step, and where its run began.
    """
    dealt = ranged(events.select(*keys, *order, number), *[F.col(c) for c in (*keys, *order)])
    w = Window.partitionBy("_range", *keys).orderBy(*order)

    with_ = lambda df, values: handed(df, keys, order, values)
    df = with_(dealt, {"_number": (F.col(number), "last")})
    step = F.col(number) - F.coalesce(F.lag(number).over(w), F.col("_number"))
    df = df.withColumn("_step", step).withColumn("_step", F.when(F.abs("_step") == 1, F.col("_step"))).drop("_number")
    df = with_(shared(df, "steps"), {"_was": (F.struct("_step"), "last")})
    was = F.coalesce(F.lag(F.struct("_step")).over(w), F.col("_was"))["_step"]
    turn = F.col("_step").isNull() | ~F.coalesce(F.col("_step") == was, F.lit(False))
    df = df.withColumns({"_turn": turn, "_reset": F.col("_step").isNull().cast("int"), "_no": F.row_number().over(w)}).drop("_was")
    df = with_(shared(df, "turns"), {"_rows": (F.lit(1), "count"), "_resets": (F.col("_reset"), "sum")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_no": F.col("_no") + F.coalesce("_rows", F.lit(0)), "_segment": F.sum("_reset").over(upto) + F.coalesce("_resets", F.lit(0))}).drop("_rows", "_resets")
    df = with_(shared(df, "runs"), {"_start": (F.when(F.col("_turn"), F.col("_no")), "last")})
    start = F.coalesce(F.last(F.when(F.col("_turn"), F.col("_no")), ignorenulls=True).over(upto), F.col("_start"))
    df = df.withColumn("length", F.when(F.col("_step").isNull(), 1).otherwise(F.col("_no") - start + 2).cast("int"))
    hit = df.where(F.col("length") >= least).groupBy(*keys, "_segment").agg(F.min_by(F.struct(*order, F.col(number).alias("current"), "length", "_step"), F.struct(*order)).alias("h"))
    return hit.select(*keys, *[F.col(f"h.{c}").alias(c) for c in order], "h.current", "h.length", F.when(F.col("h._step") == 1, "ascending").otherwise("descending").alias("direction"))


def arrivals(events: DataFrame, keys: list[str], seq: str, order: list[str], cap: int = 4_096) -> DataFrame:
    """keys, order, seq, state and lost of each numbered event, in the order of arrival: first, advance, reordered, replay or gap.

    A number above all before it advances, and those that it leaps over are missing. A missing one that comes later is reordered, any other
    is a replay. Of the missing ones cap are kept; when more would be, the lowest are given up as lost (a gap, and how many), and are replays
    if they come after all. Ranges of the order hand on the highest number, and a number's first arrival tells whether it came before. Only
    streams that have more than cap numbers missing at some time are followed in order, with the missing ranges of at most cap numbers as state.
    """
    own = [*keys, *order]
    dealt = ranged(events.select(*own, F.col(seq).cast("long").alias(seq)), *[F.col(c) for c in own])
    w, at = Window.partitionBy("_range", *keys).orderBy(*order), F.struct(*order)
    begun = F.first(seq).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(seq).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = handed(dealt, keys, order, {"_high": (F.col(seq), "max"), "_begun": (F.col(seq), "first")})
    df = df.withColumns({"_high": F.greatest("_high", before), "_begun": F.coalesce(F.col("_begun"), begun)})
    came = dealt.groupBy(*keys, seq).agg(F.min(at).alias("_came")).withColumnsRenamed({c: f"{c}__" for c in (*keys, seq)})
    df = df.join(came, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in (*keys, seq)]).drop(*[f"{c}__" for c in (*keys, seq)])
    state = F.when(F.col("_high").isNull(), "first").when(F.col(seq) > F.col("_high"), "advance").when((at == F.col("_came")) & (F.col(seq) > F.col("_begun")), "reordered").otherwise("replay")
    more = F.when(F.col("state") == "advance", F.col(seq) - F.col("_high") - 1).when(F.col("state") == "reordered", -1).otherwise(0)
    df = shared(df.withColumn("state", state).withColumn("_more", more).drop("_high", "_begun", "_came"), "arrivals")
    df = handed(df, keys, order, {"_open": (F.col("_more"), "sum")})
    missing = F.sum("_more").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_open", F.lit(0))
    deep = shared(df.withColumn("_missing", missing).groupBy(*keys).agg((F.max("_missing") > cap).alias("_deep")).where("_deep").withColumnsRenamed({k: f"{k}__" for k in keys}), "deep")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    told = df.join(deep, same, "left_anti").select(*own, seq, "state", F.lit(0).cast("long").alias("lost"))
    rows = dealt.join(deep, same, "left_semi").select(*own, seq)
    return told.unionByName(_followed(rows, keys, seq, order, cap))


def _followed(rows: DataFrame, keys: list[str], seq: str, order: list[str], cap: int) -> DataFrame:
    """The states of streams that are followed in order."""
    width = len(keys)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, high, missing, held = object(), None, [], 0  # missing: ranges [from, to) in order
        for batch in batches:
            states, losses = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != key:
                    key, high, missing, held = row[:width], None, [], 0
                n, lost = row[-1], 0
                k = bisect_right(missing, [n, float("inf")]) - 1
                if high is None:
                    high, state = n, "first"
                elif n > high:
                    state = "advance"
                    if n > high + 1:
                        missing.append([high + 1, n])
                        held += n - high - 1
                    high = n
                    lost = max(0, held - cap)
                    held -= lost
                    left = lost
                    while left:
                        state, size = "gap", missing[0][1] - missing[0][0]
                        if size <= left:
                            missing.pop(0)
                        else:
                            missing[0][0] += left
                        left -= min(size, left)
                elif k >= 0 and missing[k][0] <= n < missing[k][1]:
                    state, held = "reordered", held - 1
                    a, b = missing[k]
                    missing[k : k + 1] = [x for x in ([a, n], [n + 1, b]) if x[0] < x[1]]
                else:
                    state = "replay"
                states.append(state)
                losses.append(lost)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string()), pa.array(losses, pa.int64())], names=[*batch.schema.names, "state", "lost"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{schema}, state string, lost long")
