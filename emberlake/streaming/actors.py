"""Keyed state with bounds: what an actor touches in a sliding window, and cases with a suppression window, as streams.

State is a few numbers and one map for each key, in the state store; a timer takes it away after IDLE of the stream's clock. That
clock is the lesser of an event's own time and the time that it was received, so a time in the future can't age the state of others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Entries of an actor's window; milliseconds without events after which an actor is forgotten.
ENTRIES, IDLE_MS = 4_096, 30 * 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Sets the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Timed(StatefulProcessor):
    """Forgets a key whose clock has stood still for idle_ms."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def recalled(self, timerValues, empty: tuple) -> tuple:
        """The key's state, whose first value is its clock; the empty one if there is none, or if the stream's clock has left it behind (timers come after rows)."""
        held = tuple(self.held.get()) if self.held.exists() else empty
        return empty if held[0] is not None and timerValues.getCurrentWatermarkInMs() >= held[0] + self.idle_ms else held

    def put_off(self, clock_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(clock_ms + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Probing(_Timed):
    """Fires when an actor has touched `least` distinct resources in a window, once until no more than `rearm` are left.

    The window ends at the actor's latest time, which a late event doesn't move: one within the window counts, an older one doesn't. Of more
    than `entries` resources the oldest go.
    """

    state = "clock_ms long, latest long, armed boolean, resources array<string>, times array<long>"

    def __init__(self, width_us: int, least: int, rearm: int, entries: int = ENTRIES, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.width_us, self.least, self.rearm, self.entries = width_us, least, rearm, entries

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock, latest, armed, names, times = self.recalled(timerValues, (None, None, True, [], []))
        window, clock, out = dict(zip(names, times)), clock or 0, []
        for r in sorted(rows, key=lambda r: (r["received_us"], r["us"], r["resource"])):
            clock = max(clock, min(r["us"], r["received_us"]) // 1000)
            latest = r["us"] if latest is None else max(latest, r["us"])
            if r["us"] >= latest - self.width_us:
                window[r["resource"]] = max(r["us"], window.get(r["resource"], r["us"]))
            window = {k: t for k, t in window.items() if t >= latest - self.width_us}
            while len(window) > self.entries:
                window.pop(min(window, key=lambda k: (window[k], k)))
            if armed and len(window) >= self.least:
                armed = False
                out.append(Row(actor=key[0], us=r["us"], resources=len(window)))
            elif len(window) <= self.rearm:
                armed = True
        self.held.update((clock, latest, armed, list(window), list(window.values())))
        self.put_off(clock)
        return iter(out)


class Suppression(_Timed):
    """Opens a case, counts a repeat to it (which slides the window), or drops one whose case is closed, by whole seconds.

    Rows have second, closing and n; a closing closes the key's case and comes before the detections of its second.
    """

    state = "clock_ms long, mark long, case_no long, open boolean"

    def __init__(self, realert_s: int, idle_ms: int = IDLE_MS):
        super().__init__(idle_ms)
        self.realert_s = realert_s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock, mark, case, open_ = self.recalled(timerValues, (None, None, 0, False))
        clock, out = clock or 0, []
        for r in sorted(rows, key=lambda r: (r["second"], not r["closing"])):
            clock = max(clock, min(r["second"] * 1000, r["received_us"] // 1000))
            if r["closing"]:
                open_ = False
                continue
            if mark is not None and r["second"] - mark < self.realert_s:
                did = "counted" if open_ else "dropped"
            else:
                did, case, open_ = "opened", case + 1, True
            mark = mark if did == "dropped" else r["second"]
            out.append(Row(key=key[0], second=r["second"], case_no=case, did=did))
        self.held.update((clock, mark, case, open_))
        self.put_off(clock)
        return iter(out)


def _clocked(events: DataFrame, late: str) -> DataFrame:
    """events with the stream's clock as their watermark's column."""
    return events.withColumn("clock", F.timestamp_micros(F.least("us", "received_us"))).withWatermark("clock", late)


def probing(events: DataFrame, width_us: int, least: int, rearm: int, entries: int = ENTRIES, late: str = "30 days", idle_ms: int = IDLE_MS) -> DataFrame:
    """(actor, us, resources) when an actor fires; events: actor, resource, us, received_us. What the clock has left behind by `late` isn't looked at."""
    rows = _clocked(events.select("actor", "resource", "us", "received_us").where("actor IS NOT NULL AND trim(actor) <> '' AND resource IS NOT NULL"), late)
    return rows.groupBy("actor").transformWithState(Probing(width_us, least, rearm, entries, idle_ms), "actor string, us long, resources int", "Append", "EventTime")


def suppressed(detections: DataFrame, realert_s: int, late: str = "1 day", idle_ms: int = IDLE_MS) -> DataFrame:
    """(key, second, case_no, did) for each detection; detections: key, us, received_us, closing."""
    rows = _clocked(detections.select("key", "us", "received_us", "closing", F.floor(F.col("us") / 1_000_000).alias("second")), late)
    return rows.groupBy("key").transformWithState(Suppression(realert_s, idle_ms), "key string, second long, case_no long, did string", "Append", "EventTime")
