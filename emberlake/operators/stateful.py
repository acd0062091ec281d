"""Per-actor detectors over a sliding window, with re-arming; runs of ids; growth of what a session touches.

Running values are taken in blocks of time: sums of whole blocks, carried over by a window over the blocks alone, and
a window within each block. So an actor with a large share of all events is dealt over its blocks.
What such a step reads twice is a written table, so that nothing before it is computed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.ordered import shared

DAY_US = 86_400_000_000


def running(steps: DataFrame, actor: str, t: str, values: list[str], block_us: int = DAY_US) -> DataFrame:
    """steps, one row for each actor and time, with the running sums of values up to that time."""
    df = steps.withColumn("_block", F.floor(F.col(t) / block_us))
    blocks = df.groupBy(actor, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(actor).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(actor, "_block", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    within = Window.partitionBy(actor, "_block").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    sums = [(F.sum(v).over(within) + F.col(f"_{v}")).alias(v) for v in values]
    return df.join(carried, [actor, "_block"]).select(*[c for c in steps.columns if c not in values], *sums)


def sliding(events: DataFrame, actor: str, t: str, width_us: int, distinct: dict[str, str] | None = None, sums: dict[str, str] | None = None, older_us: int | None = None) -> DataFrame:
    """A row for each actor and time of an event, with the values over the events of the last width_us, that time included.

    distinct and sums: name of the value: column. older_us adds `older`, the number of events of the window that
    are older than that. A distinct value counts from an event before which it wasn't in the window until it leaves that.
    """
    distinct, sums = distinct or {}, sums or {}
    names = [*distinct, *sums, "events", *(["older"] if older_us is not None else [])]
    step = lambda at, **d: F.struct(at.alias("t"), *[(d.get(n, F.lit(0))).cast("long").alias(n) for n in names], d.get("_seen", F.lit(0)).alias("_seen"))
    parts = []
    for name, value in distinct.items():
        each = events.where(F.col(value).isNotNull()).select(actor, F.col(t).alias("_t"), F.col(value).alias("_v"))
        same = Window.partitionBy(actor, "_v").orderBy("_t")
        far = lambda gap: F.coalesce(gap > width_us, F.lit(True))
        each = each.select(actor, "_t", far(F.col("_t") - F.lag("_t").over(same)).alias("_comes"), far(F.lead("_t").over(same) - F.col("_t")).alias("_goes"))
        changes = F.array(F.when(F.col("_comes"), step(F.col("_t"), **{name: F.lit(1)})), F.when(F.col("_goes"), step(F.col("_t") + width_us + 1, **{name: F.lit(-1)})))
        parts.append(each.where("_comes OR _goes").select(actor, F.explode(changes).alias("s")).where("s IS NOT NULL"))
    adds = {"events": F.lit(1), **{n: F.col(c) for n, c in sums.items()}}
    leaves = {n: -c for n, c in adds.items()} | ({"older": F.lit(-1)} if older_us is not None else {})
    own = [step(F.col(t), _seen=F.lit(1), **adds), step(F.col(t) + width_us + 1, **leaves)]
    if older_us is not None:
        own.append(step(F.col(t) + older_us, older=F.lit(1)))
    parts.append(events.select(actor, F.explode(F.array(*own)).alias("s")))
    steps = parts[0]
    for p in parts[1:]:
        steps = steps.unionByName(p)
    at = steps.groupBy(actor, F.col("s.t").alias("t")).agg(*[F.sum(f"s.{n}").alias(n) for n in names], F.max("s._seen").alias("_seen"))
    return running(shared(at, "steps"), actor, "t", names).where("_seen = 1").drop("_seen")


def fired(df: DataFrame, actor: str, t: str, hot: Column, cold: Column, block_us: int = DAY_US) -> DataFrame:
    """The rows at which an actor's detector fires: hot, while it is armed; it arms again at the next row that is cold."""
    df = df.withColumn("_s", F.when(hot, 1).when(cold, 0)).withColumn("_block", F.floor(F.col(t) / block_us))
    df = shared(df.where("_s IS NOT NULL"), "states")  # rows that are neither change nothing
    blocks = df.groupBy(actor, "_block").agg(F.max_by("_s", t).alias("_last"))
    carried = blocks.select(actor, "_block", F.lag("_last").over(Window.partitionBy(actor).orderBy("_block")).alias("_carried"))
    before = F.lag("_s").over(Window.partitionBy(actor, "_block").orderBy(t))
    out = df.join(carried, [actor, "_block"]).withColumn("_was", F.coalesce(before, F.col("_carried"), F.lit(0)))
    return out.where("_s = 1 AND _was = 0").drop("_s", "_was", "_block", "_carried")


def low_and_slow(events: DataFrame, actor: str, subject: str, session: str, t: str, width_us: int = 14 * DAY_US, subjects: int = 40, sessions: int = 3, span_us: int = 21_600_000_000, rearm: int = 20) -> DataFrame:
    """Actors that reach many distinct subjects over several sessions and hours; fires once until the number recedes."""
    df = sliding(events.where(F.col(subject).isNotNull()), actor, t, width_us, {"subjects": subject, "sessions": session}, older_us=span_us)
    hot = (F.col("subjects") >= subjects) & (F.col("sessions") >= sessions) & (F.col("older") > 0)
    return fired(df, actor, "t", hot, F.col("subjects") <= rearm).select(actor, "t", "subjects", "sessions")


def split_bulk(events: DataFrame, actor: str, rows: str, t: str, width_us: int = 3_600_000_000, least: int = 100_000, queries: int = 12, rearm: int = 20_000) -> DataFrame:
    """Actors that read many rows by many reads, none of them bulk by itself."""
    df = sliding(events.where(F.col(rows) > 0), actor, t, width_us, sums={"rows": rows})
    return fired(df, actor, "t", (F.col("rows") >= least) & (F.col("events") >= queries), F.col("rows") <= rearm).select(actor, "t", "rows", F.col("events").alias("queries"))


def denied_probing(events: DataFrame, actor: str, resource: str, t: str, width_us: int = 3_600_000_000, least: int = 6, rearm: int = 2) -> DataFrame:
    """Actors whose denied accesses probe many distinct resources."""
    df = sliding(events, actor, t, width_us, {"resources": resource})
    return fired(df, actor, "t", F.col("resources") >= least, F.col("resources") <= rearm).select(actor, "t", "resources")


def sequential(events: DataFrame, keys: list[str], number: str, order: list[str], least: int = 12) -> DataFrame:
    """Adjacent ids walked up or down, so many in a row; once until an id isn't adjacent. A turn starts anew at two ids."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = events.withColumn("_step", F.col(number) - F.lag(number).over(w))
    df = df.withColumn("_step", F.when(F.abs("_step") == 1, F.col("_step")))
    df = df.withColumn("_reset", F.col("_step").isNull().cast("int")).withColumn("_turn", (F.col("_step").isNull() | ~F.coalesce(F.col("_step") == F.lag("_step").over(w), F.lit(False))).cast("int"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_segment", F.sum("_reset").over(upto)).withColumn("_run", F.sum("_turn").over(upto))
    inner = Window.partitionBy(*keys, "_run").orderBy(*order)
    df = df.withColumn("length", F.when(F.col("_step").isNull(), 1).otherwise(F.row_number().over(inner) + 1))
    hits = df.where(F.col("length") >= least).withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "_segment").orderBy(*order)))
    return hits.where("_first = 1").select(*keys, *order, F.col(number).alias("current"), "length", F.when(F.col("_step") == 1, "ascending").otherwise("descending").alias("direction"))


def cross_domain(events: DataFrame, actor: str, session: str, domain: str, t: str, least: int = 2) -> DataFrame:
    """Each new combination of domains that an actor touches in one session, when it is first complete."""
    first = events.where(F.col(session).isNotNull() & F.col(domain).isNotNull()).groupBy(actor, session, domain).agg(F.min(t).alias("t"))
    w = Window.partitionBy(actor, session).orderBy("t", domain).rowsBetween(Window.unboundedPreceding, 0)  # no more rows than domains
    combos = first.select(actor, "t", F.array_sort(F.collect_list(domain).over(w)).alias("all")).where(F.size("all") >= least)
    return combos.groupBy(actor, F.array_join("all", " + ").alias("domains")).agg(F.min("t").alias("t"))


def sequence_gaps(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, first, last, seen, missing, replayed) for numbered streams: how many numbers lack, how many came again."""
    out = events.groupBy(*keys).agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("seen"), F.count_distinct(seq).alias("numbers"))
    return out.select(*keys, "first", "last", "seen", (F.col("last") - F.col("first") + 1 - F.col("numbers")).alias("missing"), (F.col("seen") - F.col("numbers")).alias("replayed"))


def gaps(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each run of numbers that lack: (keys, from, to)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    out = events.select(*keys, seq).distinct().withColumn("_before", F.lag(seq).over(w)).where(F.col(seq) - F.col("_before") > 1)
    return out.select(*keys, (F.col("_before") + 1).alias("from_no"), (F.col(seq) - 1).alias("to_no"))

