"""Structured Streaming forms: dedup, windowed bursts, and detections that fire once and re-arm."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, ts: str = "event_ts", late: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Each event once, within the watermark; state is bounded by time."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_bursts(events: DataFrame, key: str, least: int, ts: str = "event_ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("w.start").alias("start"), key, "n")


def enumeration(events: DataFrame, key: str, number: str, ts_us: str, least: int = 12) -> DataFrame:
    """(key, last, length) when a run of numbers that go one up or one down reaches `least`, once for each run.

    A turn of direction starts at two and doesn't fire again; a number that isn't next to the last one starts anew.
    State is four numbers for each key, and goes after a day without events.
    """

    def work(k: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, way, run, fired = state.get if state.exists else (None, 0, 0, False)
        out = []
        for batch in batches:
            for n in batch.sort_values([ts_us, number])[number]:
                n = int(n)
                step = 0 if last is None else n - last
                if step in (1, -1):
                    run = run + 1 if step == way or way == 0 else 2
                    way = step
                else:
                    way, run, fired = 0, 1, False
                last = n
                if run >= least and not fired:
                    fired = True
                    out.append((k[0], n, run))
        state.update((last, way, run, fired))
        state.setTimeoutDuration(86_400_000)
        if out:
            yield pd.DataFrame(out, columns=[key, "last", "length"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, last long, length int", "last long, way int, run int, fired boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def caught_up(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that there is now, written to folder with its checkpoint; a later call takes up where this one ended."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
