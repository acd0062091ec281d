"""Old events: seal plans, archives with a manifest, erasure, expiry, capacity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.sources import versions

DAY_US = 86_400_000_000


def seal_plan(events: DataFrame, ts_us: str, window_us: int, cutoff_us: int, watermark_us: int, excluded: list[str]) -> DataFrame:
    """(start_us, end_us, rows): whole windows that end by the cutoff and start from the watermark on, with the rows to seal."""
    df = events.select((F.expr(f"{ts_us} div {window_us}") * window_us).alias("start_us"), "source").where(F.col("start_us").isNotNull())
    out = df.groupBy("start_us").agg(F.count_if(~F.col("source").isin(excluded)).alias("rows")).withColumn("end_us", F.col("start_us") + window_us)
    return out.where((F.col("end_us") <= cutoff_us) & (F.col("start_us") >= watermark_us)).select("start_us", "end_us", "rows")


def checksum(df: DataFrame) -> Column:
    """A sum over rows that doesn't depend on their order."""
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))


def seal(events: DataFrame, ts_us: str, plan: DataFrame, window_us: int, excluded: list[str], folder: str) -> DataFrame:
    """Writes the windows of plan (a bounded list) as compressed Parquet by window; returns the manifest (start_us, end_us, rows, checksum)."""
    df = events.where(~F.col("source").isin(excluded)).withColumn("window_us", F.expr(f"{ts_us} div {window_us}") * window_us)
    df = df.join(F.broadcast(plan.select(F.col("start_us").alias("window_us"))), "window_us", "left_semi")  # one row for each window
    df.write.mode("append").partitionBy("window_us").option("compression", "zstd").parquet(folder)
    return manifest(events.sparkSession, folder, df.schema, window_us)


def manifest(spark: SparkSession, folder: str, schema, window_us: int) -> DataFrame:
    """What is in an archive folder, counted from its files."""
    df = spark.read.schema(schema).parquet(folder)
    own = df.drop("window_us")
    return df.groupBy(F.col("window_us").alias("start_us")).agg(F.count("*").alias("rows"), checksum(own).alias("checksum")).withColumn("end_us", F.col("start_us") + window_us)


def overlapping(archives: DataFrame, from_us: int | None, to_us: int | None) -> DataFrame:
    """Archives that hold times of [from, to); an open end holds all."""
    late = F.col("end_us") > from_us if from_us is not None else F.lit(True)
    early = F.col("start_us") < to_us if to_us is not None else F.lit(True)
    return archives.where(late & early)


def cold(spark: SparkSession, folder: str, archives: DataFrame, from_us: int | None, to_us: int | None, ts_us: str, schema, most_rows: int | None = None) -> DataFrame:
    """The archived events of a range: partitions outside it aren't read, and what is read is checked against the manifest.

    A query without bounds over more than most_rows is refused.
    """
    found = overlapping(archives, from_us, to_us)
    if most_rows is not None and from_us is None and to_us is None and (found.agg(F.sum("rows")).first()[0] or 0) > most_rows:
        raise ValueError("a query of all archives needs bounds of time")
    df = spark.read.schema(schema).parquet(folder).join(F.broadcast(found.select(F.col("start_us").alias("window_us"))), "window_us", "left_semi")  # one row for each window
    now = df.groupBy(F.col("window_us").alias("start_us")).agg(F.count("*").alias("n"), checksum(df.drop("window_us")).alias("c"))
    wrong = found.join(now, "start_us", "left").where("n IS NULL OR n <> rows OR c <> checksum").limit(1).collect()
    if wrong:
        raise ValueError(f"the archive from {wrong[0]['start_us']} doesn't hold what its manifest says")
    inside = F.lit(True)
    if from_us is not None:
        inside = inside & (F.col(ts_us) >= from_us)
    if to_us is not None:
        inside = inside & (F.col(ts_us) < to_us)
    return df.where(inside).drop("window_us")


def needle(key: str, value: str) -> Column:
    """Whether the JSON bag has the value under the key."""
    return F.coalesce(F.get_json_object("fields", f"$['{key}']") == value, F.lit(False))


def _named(t: dict, ts_us: str) -> Column:
    """Whether a tombstone names the row: a host, or a key and value of the bag, in [from, to) where given."""
    hit = F.col("host") == t["host"] if "host" in t else needle(t["key"], t["value"])
    if t.get("from_us") is not None:
        hit = hit & (F.col(ts_us) >= t["from_us"])
    if t.get("to_us") is not None:
        hit = hit & (F.col(ts_us) < t["to_us"])
    return F.coalesce(hit, F.lit(False))


def erased(events: DataFrame, ts_us: str, tombstones: list[dict]) -> DataFrame:
    """events without those that a tombstone names."""
    return events.where(~reduce(lambda a, b: a | b, [_named(t, ts_us) for t in tombstones], F.lit(False)))


def _covers(t: dict, start_us: int, end_us: int) -> bool:
    """Whether a tombstone's time meets that of an archive."""
    return (t.get("from_us") is None or end_us > t["from_us"]) and (t.get("to_us") is None or start_us < t["to_us"])


def seal_parts(events: DataFrame, ts_us: str, plan: DataFrame, window_us: int, excluded: list[str], folder: str, holds: list[tuple[int, int]] = ()) -> list[str]:
    """Seals each window of plan (a bounded list) as a part of its own, with its rows and checksum as facts; all hold from one commit on."""
    spark, run = events.sparkSession, versions.new_part()
    df = events.where(~F.col("source").isin(excluded)).withColumn("window_us", F.expr(f"{ts_us} div {window_us}") * window_us)
    df = df.join(F.broadcast(plan.select(F.col("start_us").alias("window_us"))), "window_us", "left_semi")  # one row for each window
    return _sealed(spark, df.withColumn("part", F.concat(F.col("window_us").cast("string"), F.lit(f"-{run}"))).drop("window_us"), folder, {}, window_us, holds)


def _sealed(spark: SparkSession, df: DataFrame, folder: str, replaces: dict[str, str], window_us: int, holds: list[tuple[int, int]] = ()) -> list[str]:
    """Writes df (with `part`) and commits its parts; replaces: the new part of each that goes. A part that keeps no row replaces as an empty one."""
    schema = df.drop("part").schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    df.repartition("part").write.mode("append").partitionBy("part").option("compression", "zstd").parquet(f"{folder}/archives")
    wanted = [r["part"] for r in df.select("part").distinct().collect()]  # windows
    held = versions.read(spark, folder, "archives", wanted, f"{schema}, part string")
    told = {r["part"]: r for r in held.groupBy("part").agg(F.count("*").alias("rows"), checksum(held.drop("part")).alias("checksum")).collect()}
    commits = []
    for part in sorted({*told, *replaces.values()}):
        start = int(part.split("-")[0])
        hold = any(lo < start + window_us and hi > start for lo, hi in holds)
        facts = {"start_us": start, "end_us": start + window_us, "rows": told[part]["rows"] if part in told else 0, "checksum": told[part]["checksum"] if part in told else "None", "hold": hold, "schema": schema}
        if part not in told:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/archives/part={part}")
        commits.append((part, [old for old, new in replaces.items() if new == part], facts))
    versions.commit_all(spark, folder, commits)
    return sorted(told)


def verified(spark: SparkSession, folder: str, parts: list) -> DataFrame:
    """The rows of archives, after their rows and checksums have been held against their facts: what is tampered with is never rewritten."""
    schema = parts[0]["facts"]["schema"]
    df = versions.read(spark, folder, "archives", [p["part"] for p in parts], f"{schema}, part string")
    now = {r["part"]: (str(r["rows"]), str(r["checksum"])) for r in df.groupBy("part").agg(F.count("*").alias("rows"), checksum(df.drop("part")).alias("checksum")).collect()}
    for p in parts:
        if now.get(p["part"], ("0", "None")) != (p["facts"]["rows"], p["facts"]["checksum"]):
            raise ValueError(f"the archive {p['part']} doesn't hold what its facts say")
    return df


def erase_archives(spark: SparkSession, folder: str, ts_us: str, tombstones: list[dict], window_us: int) -> list[tuple[str, int]]:
    """Takes what the tombstones name out of the archives' files; (archive, rows taken) for each whose time a tombstone meets.

    A held archive among them refuses the whole. Archives that lose rows are verified, written anew and swapped in by one commit; after it
    the old files are emptied. A run that breaks before the commit leaves the old state; one that breaks after it is ended by versions.swept.
    """
    met = [p for p in versions.live(spark, folder) if any(_covers(t, int(p["facts"]["start_us"]), int(p["facts"]["end_us"])) for t in tombstones)]
    if not met:
        return []
    held = [p["part"] for p in met if p["facts"]["hold"] == "True"]
    if held:
        raise ValueError(f"the archive {held[0]} is held, so nothing is erased")
    df = verified(spark, folder, met)
    gone = reduce(lambda a, b: a | b, [_named(t, ts_us) for t in tombstones])
    lost = {r["part"]: r["n"] for r in df.where(gone).groupBy("part").agg(F.count("*").alias("n")).collect()}
    if lost:
        run = versions.new_part()
        new = {part: f"{part.split('-')[0]}-{run}" for part in lost}
        kept = df.where(F.col("part").isin(*lost) & ~gone).withColumn("part", F.concat(F.substring_index("part", "-", 1), F.lit(f"-{run}")))
        _sealed(spark, kept, folder, new, window_us)
        versions.swept(spark, folder, {"archives": met[0]["facts"]["schema"]})
    return [(p["part"], lost.get(p["part"], 0)) for p in met]


def expiry(archives: DataFrame, cutoff_us: int, holds: list[tuple[int, int]]) -> DataFrame:
    """Archives that end by the cutoff, and whether a hold (from, to) keeps them."""
    held = F.lit(False)
    for lo, hi in holds:
        held = held | ((F.col("start_us") < hi) & (F.col("end_us") > lo))
    return archives.where(F.col("end_us") <= cutoff_us).withColumn("held", held)


def capacity(archives: DataFrame, free_bytes: int) -> DataFrame:
    """One row: rows, bytes, compression ratio, bytes a day and days until the free space is used."""
    out = archives.agg(F.sum("rows").alias("rows"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("bytes").alias("bytes"), ((F.max("end_us") - F.min("start_us")) / DAY_US).alias("days"))
    return out.select("rows", "raw_bytes", "bytes", (F.col("raw_bytes") / F.nullif("bytes", F.lit(0))).alias("ratio"), (F.col("bytes") / F.nullif("days", F.lit(0))).alias("per_day"), (free_bytes * F.col("days") / F.nullif("bytes", F.lit(0))).alias("days_left"))


def hot_and_cold(hot: DataFrame, cold_events: DataFrame) -> DataFrame:
    """The events of the table and of the archives, those in both once, by id."""
    return hot.unionByName(cold_events.join(hot.select("event_id"), "event_id", "left_anti"), allowMissingColumns=True)
