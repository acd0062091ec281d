"""What is unusual: templates, bursts, silence, baselines, and sequences per actor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import template, template_id
from emberlake.sources.events import micros

HOUR_US = 3_600_000_000


def templates(events: DataFrame) -> DataFrame:
    """Template groups: count, distinct hosts, first and last time."""
    df = events.select("host", "event_ts", template(F.col("message")).alias("template"))
    return df.groupBy("template").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.min(micros("event_ts")).alias("first_us"), F.max(micros("event_ts")).alias("last_us")).withColumn("template_id", template_id(F.col("template")))


def new_templates(recent: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Templates of recent events that no known event has."""
    return templates(recent).where(F.col("n") >= least).join(templates(known).select("template_id"), "template_id", "left_anti")


def bursts(events: DataFrame, hour: Column, days: int = 14, least: int = 5, k: float = 3.0, min_days: int = 3) -> DataFrame:
    """(host, service) pairs whose count in an hour exceeds median + k * max(MAD, 1) of the same hour on the days before.

    Days without events count as zero, from the pair's first day on. One scan: counts by day of that hour.
    """
    start = hour - F.expr(f"INTERVAL {days} DAYS")
    df = events.where((F.col("event_ts") >= start) & (F.col("event_ts") < hour + F.expr("INTERVAL 1 HOUR")))
    first = df.groupBy("host", "service").agg(F.min("event_ts").alias("first_ts"))
    day = F.expr("timestampdiff(DAY, date_trunc('DAY', event_ts), date_trunc('DAY', _hour))")
    counts = df.withColumn("_hour", hour).where(F.hour("event_ts") == F.hour("_hour")).groupBy("host", "service", day.alias("ago")).agg(F.count("*").alias("n"))
    now = counts.where("ago = 0").where(F.col("n") >= least).select("host", "service", F.col("n").alias("now"))
    span = F.least(F.lit(days), F.greatest(F.lit(0), F.expr("timestampdiff(DAY, date_trunc('DAY', first_ts), date_trunc('DAY', _hour))")))
    spine = now.join(first, ["host", "service"]).withColumn("_hour", hour).withColumn("key_days", span).where(F.col("key_days") >= min_days)
    spine = spine.select("host", "service", "now", "key_days", F.explode(F.sequence(F.lit(1).cast("long"), F.col("key_days").cast("long"))).alias("ago"))
    filled = spine.join(counts, ["host", "service", "ago"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    med = filled.groupBy("host", "service", "now", "key_days").agg(F.median("n").alias("med"), F.collect_list("n").alias("all"))  # no more than `days` values
    mad = F.expr("array_sort(transform(all, x -> abs(x - med)))")
    mid = lambda a: (F.element_at(a, F.ceil(F.size(a) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    out = med.withColumn("mad", mid(mad)).withColumn("threshold", F.col("med") + k * F.greatest(F.col("mad"), F.lit(1.0)))
    return out.where("now > threshold").select("host", "service", "now", "med", "mad", F.when(F.col("now") >= 3 * F.col("threshold"), "high").otherwise("medium").alias("level"))


def silence(events: DataFrame, key: str, now_us: int, least: int, limit_us: int, watch_us: int = 7 * 24 * HOUR_US) -> DataFrame:
    """Producers with enough events (by their own time) in the watch window, of which none has come in for too long."""
    watched = events.where(micros("event_ts") >= now_us - watch_us)
    out = watched.groupBy(F.col(key).alias("subject")).agg(F.count("*").alias("n"), F.max(micros("ingest_time")).alias("last_us")).where(F.col("subject").isNotNull() & (F.col("n") >= least))
    silent = F.expr(f"({now_us} - last_us) div 1000000")
    out = out.withColumn("silent_s", silent).where(F.col("silent_s") > limit_us // 1_000_000)
    return out.withColumn("level", F.when(F.col("silent_s") >= 24 * 3600, "critical").when(F.col("silent_s") >= 6 * 3600, "high").otherwise("medium"))


def weighted_median(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """(key, median) from counts by value: the middle one, or the mean of the two middle ones. Values of one key are
    ordered by a window over counts, so a key's rows don't meet in memory, and equal values are one row."""
    upto = F.sum(n).over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counts.groupBy(key).agg(F.sum(n).alias("_total"))
    df = counts.withColumn("_upto", upto).join(total, key)
    holds = lambda rank: (F.col("_upto") - F.col(n) < rank) & (rank <= F.col("_upto"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return df.where(holds(low) | holds(high)).groupBy(key).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))


def numeric_baseline(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, standard deviation, median and MAD per key, and the upper z of the largest value (infinite without any spread)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    med = weighted_median(counts, key, value)
    away = counts.join(med, key).groupBy(key, F.abs(F.col(value) - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    mad = weighted_median(away, key, "away").withColumnRenamed("median", "mad")
    own = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.max(value).alias("top"))
    z = F.when(F.col("mad") > 0, (F.col("top") - F.col("median")) / (1.4826 * F.col("mad"))).when(F.col("sd") > 0, (F.col("top") - F.col("mean")) / F.col("sd")).when(F.col("top") > F.col("median"), F.lit(float("inf"))).otherwise(0.0)
    return own.join(med, key).join(mad, key).withColumn("upper_z", z)


def rare_hours(events: DataFrame, key: Column, least: int = 20, share: float = 0.1) -> DataFrame:
    """Hours in which an entity is rarely seen: none, or under a share of its peak. 24 rows for each entity."""
    counts = events.groupBy(key.alias("subject"), F.hour("event_ts").alias("hour")).agg(F.count("*").alias("n"))
    total = counts.groupBy("subject").agg(F.sum("n").alias("total"), F.max("n").alias("peak")).where(F.col("total") >= least)
    spine = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return spine.join(counts, ["subject", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where((F.col("n") == 0) | (F.col("n") < share * F.col("peak"))).select("subject", "hour", "n")


def sliding_distinct(df: DataFrame, actor: str, value: str, ts_us: str, width_us: int, least: int) -> DataFrame:
    """Actors whose events of some window of width_us, ending at an event, have so many distinct values; the most, and when first.

    A value counts in a window if its latest event does, so counting changes is enough: each (actor, value)
    event adds one from its time until the next event of the same value, or its expiry.
    """
    w = Window.partitionBy(actor, value).orderBy(ts_us)
    once = df.select(actor, value, ts_us).distinct()
    spans = once.withColumn("_to", F.least(F.lead(ts_us).over(w), F.col(ts_us) + width_us + 1)).withColumn("_to", F.coalesce("_to", F.col(ts_us) + width_us + 1))
    steps = spans.select(actor, F.explode(F.array(F.struct(F.col(ts_us).alias("t"), F.lit(1).alias("d")), F.struct(F.col("_to").alias("t"), F.lit(-1).alias("d")))).alias("s")).select(actor, "s.*")
    run = steps.groupBy(actor, "t").agg(F.sum("d").alias("d")).withColumn("n", F.sum("d").over(Window.partitionBy(actor).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("n") >= least).groupBy(actor).agg(F.max("n").alias("most"), F.min("t").alias("first_us"))


def sliding_sum(df: DataFrame, actor: str, value: str, ts_us: str, width_us: int, least: float, least_n: int) -> DataFrame:
    w = Window.partitionBy(actor).orderBy(ts_us).rangeBetween(-width_us, 0)
    run = df.select(actor, ts_us, F.sum(value).over(w).alias("_s"), F.count("*").over(w).alias("_n"))
    return run.where((F.col("_s") >= least) & (F.col("_n") >= least_n)).groupBy(actor).agg(F.max("_s").alias("most"), F.min(ts_us).alias("first_us"))


def runs(df: DataFrame, keys: list[str], number: str, order: list[str], least: int) -> DataFrame:
    """Runs of events whose number goes up by one each time, so many or longer: enumeration."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_new", F.when(F.col(number) - F.lag(number).over(w) == 1, 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_run").agg(F.count("*").alias("length"), F.min(number).alias("first"), F.max(number).alias("last")).where(F.col("length") >= least).drop("_run")


def chain_faults(df: DataFrame, seq: str, prev: str, own: str, record: Column | None = None) -> DataFrame:
    """Rows of a hash chain whose number or link doesn't follow from the row before, or (given what a record is hashed
    from) whose own hash isn't that of its record.

    The row before is met by a join on its number, so the chain isn't sorted in one task. A first row that isn't
    number 1 is a gap too.
    """
    before = df.select((F.col(seq) + 1).alias(seq), F.col(own).alias("_before"))
    altered = F.coalesce(F.sha2(record, 256) != F.col(own), F.lit(False)) if record is not None else F.lit(False)
    fault = F.when(altered, "record").when((F.col(seq) > 1) & F.col("_before").isNull(), "gap").when((F.col(seq) > 1) & (F.col("_before") != F.col(prev)), "link")
    return df.join(before, seq, "left").select(seq, fault.alias("fault")).where("fault IS NOT NULL")


def observed(events: DataFrame, entity: Column, dims: dict[str, Column], ts_us: Column) -> DataFrame:
    """(entity, dim, value, n, first_us, last_us): what each entity was seen with."""
    each = F.array_compact(F.array(*[F.when(c.isNotNull() & (c.cast("string") != ""), F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value"))) for d, c in dims.items()]))
    df = events.select(entity.alias("entity"), ts_us.alias("us"), F.explode(each).alias("x")).where("entity IS NOT NULL")
    return df.groupBy("entity", F.col("x.dim").alias("dim"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def trusted(events: DataFrame, entity: Column, ts_us: Column, least: int = 30, span_us: int = 3 * 24 * HOUR_US, source: Column | None = None, sources: int = 1) -> DataFrame:
    """Entities with so many observations over such a span, from so many sources: their profiles may accuse."""
    src = source if source is not None else F.lit("any")
    out = events.select(entity.alias("entity"), ts_us.alias("us"), src.alias("source")).where("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span_us"), F.count_distinct("source").alias("sources"))
    return out.where((F.col("n") >= least) & (F.col("span_us") >= span_us) & (F.col("sources") >= sources))


def novelties(events: DataFrame, key: str, entity: Column, dims: dict[str, Column], baseline: DataFrame, known: DataFrame, levels: dict[str, str]) -> DataFrame:
    """(key, dim, value, level): values that an event has and its entity's profile hasn't; entities without a trusted profile abstain."""
    each = F.array_compact(F.array(*[F.when(c.isNotNull() & (c.cast("string") != ""), F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value"))) for d, c in dims.items()]))
    df = events.select(key, entity.alias("entity"), F.explode(each).alias("x")).select(key, "entity", "x.dim", "x.value")
    df = df.join(known.select("entity"), "entity", "left_semi").join(baseline.select("entity", "dim", "value"), ["entity", "dim", "value"], "left_anti")
    level = F.coalesce(*[F.when(F.col("dim") == d, v) for d, v in levels.items()], F.lit("medium"))
    return df.select(key, "entity", "dim", "value", level.alias("level"))


def off_profile_hours(events: DataFrame, key: str, entity: Column, rare: DataFrame, known: DataFrame) -> DataFrame:
    """(key, entity, hour) of events in an hour that is rare for their entity."""
    df = events.select(key, entity.alias("entity"), F.hour("event_ts").alias("hour")).join(known.select("entity"), "entity", "left_semi")
    return df.join(rare.select(F.col("subject").alias("entity"), "hour"), ["entity", "hour"], "left_semi").select(key, "entity", "hour")


def volume_deviations(events: DataFrame, key: str, entity: Column, value: Column, baseline: DataFrame, known: DataFrame, least_z: float = 3.5, least_n: int = 20) -> DataFrame:
    """(key, entity, z) of events whose value lies far above their entity's median, in MADs (else standard deviations)."""
    b = baseline.where(F.col("n") >= least_n).select(F.col(baseline.columns[0]).alias("entity"), "median", "mean", "mad", "sd")
    df = events.select(key, entity.alias("entity"), value.alias("v")).join(known.select("entity"), "entity", "left_semi").join(b, "entity")
    z = F.when(F.col("mad") > 0, (F.col("v") - F.col("median")) / (1.4826 * F.col("mad"))).when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd")).when(F.col("v") > F.col("median"), F.lit(float("inf"))).otherwise(0.0)
    return df.withColumn("z", z).where(F.col("z") >= least_z).select(key, "entity", "z")


def peer_novelty(baseline: DataFrame, groups: DataFrame) -> DataFrame:
    """(entity, dim, value) that an entity was seen with and none of the others in its group (entity, group)."""
    df = baseline.join(groups, "entity")
    return df.groupBy("group", "dim", "value").agg(F.count_distinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").select("entity", "dim", "value")
