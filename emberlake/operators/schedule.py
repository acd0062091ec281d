"""Rules that run by a schedule, each over the time since its last success."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberlake.sources import versions


@dataclass(frozen=True)
class Rule:
    """query gives the detections of [since_us, to_us); all runs of a rule have the same columns."""

    id: str
    schedule_us: int
    window_us: int
    query: Callable[[int, int], DataFrame]


def last_runs(spark: SparkSession, folder: str) -> dict[str, int]:
    """The time of each rule's last success."""
    out: dict[str, int] = {}
    for row in versions.live(spark, folder):
        rule, at = row["facts"]["rule"], int(row["facts"]["run_us"])
        out[rule] = max(out.get(rule, at), at)
    return out


def run_due(spark: SparkSession, folder: str, rules: list[Rule], now_us: int) -> dict[str, str | None]:
    """Runs the rules that are due; the error of each that ran, or None.

    A rule reaches back to the start of its window, or to its last success if that is earlier, so what came late or was missed by failed
    runs is looked at. Its detections are written to the place of that last success and hold when the success is committed: a failed or broken run
    leaves the last success where it was, and the next one writes over what it left, so nothing comes twice.
    """
    last, told = last_runs(spark, folder), {}
    for rule in rules:
        before = last.get(rule.id)
        if before is not None and now_us - before < rule.schedule_us:
            continue
        since = now_us - rule.window_us if before is None else min(now_us - rule.window_us, before)
        part = f"{rule.id}-{'first' if before is None else before}"
        try:
            rule.query(since, now_us).write.mode("overwrite").parquet(f"{folder}/detections/part={part}")
        except Exception as error:  # a failed rule doesn't hold up the others
            told[rule.id] = str(error).splitlines()[0]
            continue
        versions.commit(spark, folder, part, {"rule": rule.id, "run_us": now_us, "since_us": since})
        told[rule.id] = None
    return told


def detections(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The detections of all successes, with rule, run_us and since_us."""
    runs = [(r["part"], r["facts"]["rule"], int(r["facts"]["run_us"]), int(r["facts"]["since_us"])) for r in versions.live(spark, folder)]
    df = versions.read(spark, folder, "detections", [r[0] for r in runs], f"{schema}, part string")
    return df.join(spark.createDataFrame(runs, "part string, rule string, run_us long, since_us long"), "part").drop("part")
