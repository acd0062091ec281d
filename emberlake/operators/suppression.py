"""What goes out and what folds to a case: throttles and suppression windows, whose clock counts whole seconds.

Both depend on what was decided before. A throttle is decided in blocks of time, so a rule with a large share of all notices is
dealt over its blocks: a block has at most a time a second, each block tells where a chain of notices that enters it
leaves it, and only these entries (those of a gap's length at the start of each block) are followed in order. Suppression
follows the seconds of a key in order, with a few numbers as state; rows of one second are counted before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.ordered import shared

SECOND_US = 1_000_000
#: Seconds of a block, or as many gaps, whichever is longer.
BLOCK_S, BLOCK_GAPS = 86_400, 4


def _chains(times, gap: int, start: int):
    """Positions of the times after which a chain that enters the block may begin, and where each ends."""
    import numpy as np

    after = np.searchsorted(times, times + gap)
    end = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            end[i] = end[after[i]]
    entries = np.arange(min(len(times), int(np.searchsorted(times, start + gap)) + 1))
    return entries, end[entries], after


def sent_seconds(times: DataFrame, rule: str, second: str, gap_s: int) -> DataFrame:
    """(rule, second): the seconds in which a notice of the rule goes out, each gap_s or more after the one before."""
    block_s = max(BLOCK_S, BLOCK_GAPS * gap_s)
    kind = times.schema[rule].dataType.simpleString()
    given = shared(times.select(F.col(rule).alias("rule"), F.col(second).alias("second"), F.floor(F.col(second) / block_s).alias("block")).distinct(), "seconds")

    def enter(key, rows):
        import numpy as np
        import pyarrow as pa

        at = np.sort(rows.column("second").to_numpy())
        first, last, _ = _chains(at, gap_s, key[1].as_py() * block_s)
        return pa.table({"rule": pa.array([key[0].as_py()] * len(first), rows.schema.field("rule").type), "block": pa.array([key[1].as_py()] * len(first), pa.int64()), "entry": pa.array(at[first]), "leave": pa.array(at[last])})

    def follow(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rule, block, last = object(), None, None
        for batch in batches:
            keep = []
            for k, (r, b, entry, leave) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if r != rule:
                    rule, block, last = r, None, None
                if b != block and (last is None or entry >= last + gap_s):
                    block, last = b, leave
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).drop_columns(["leave"])

    def walk(key, rows, entries):
        import numpy as np
        import pyarrow as pa

        out = []
        if entries.num_rows:
            at = np.sort(rows.column("second").to_numpy())
            _, _, after = _chains(at, gap_s, key[1].as_py() * block_s)
            i = int(np.searchsorted(at, entries.column("entry")[0].as_py()))
            while i < len(at):
                out.append(int(at[i]))
                i = int(after[i])
        return pa.table({"rule": pa.array([key[0].as_py()] * len(out), rows.schema.field("rule").type), "second": pa.array(out, pa.int64())})

    chains = given.groupBy("rule", "block").applyInArrow(enter, f"rule {kind}, block long, entry long, leave long")
    entered = chains.repartition("rule").sortWithinPartitions("rule", "entry").mapInArrow(follow, f"rule {kind}, block long, entry long")
    sent = given.groupBy("rule", "block").cogroup(entered.groupBy("rule", "block")).applyInArrow(walk, f"rule {kind}, second long")
    return sent.select(F.col("rule").alias(rule), F.col("second").alias(second))


def throttled(notices: DataFrame, rule: str, ts_us: str, id_col: str, gap_us: int, silences: list[tuple[str, int, int]]) -> DataFrame:
    """Notices that go out: those of no silence, and of a rule only the first in gap_us since the last that went out.

    Escalations pass the throttle and don't open its window, but a silence holds them too. The clock counts seconds; of the notices of
    one second the first by time and id goes.
    """
    quiet = reduce(lambda a, b: a | b, [(F.col(rule) == r) & (F.col(ts_us) >= lo) & (F.col(ts_us) < hi) for r, lo, hi in silences], F.lit(False))
    heard = notices.where(~F.coalesce(quiet, F.lit(False)))
    rest = heard.where(~F.col("escalation")).withColumn("_second", F.floor(F.col(ts_us) / SECOND_US))
    sent = sent_seconds(rest, rule, "_second", -(-gap_us // SECOND_US))
    first = rest.groupBy(rule, "_second").agg(F.min(F.struct(F.col(ts_us).alias("_us"), F.col(id_col).alias("_id"))).alias("_f")).join(sent, [rule, "_second"], "left_semi")
    out = rest.join(first.select(F.col("_f._id").alias(id_col)), id_col, "left_semi").drop("_second")
    return heard.where("escalation").select(*notices.columns).unionByName(out.select(*notices.columns))


def cases(detections: DataFrame, keys: list[str], ts_us: str, realert_us: int, closings: DataFrame | None = None, own_realert: Column | None = None) -> DataFrame:
    """(keys, case_no, opened_s, updated_s, events, dropped, closed_s): detections folded to cases.

    A repeat within the window since the last mark counts to the open case and marks anew, so the window slides. If the case is closed
    by then (closings: keys and ts_us), the repeat is dropped and marks nothing. A detection outside the window opens a case. A closing
    closes the key's cases, and comes before the detections of its second. own_realert: a window of the detection's own.
    """
    window = F.lit(-(-realert_us // SECOND_US))
    second = F.floor(F.col(ts_us) / SECOND_US).alias("second")
    window = F.coalesce(F.ceil(own_realert / SECOND_US), window) if own_realert is not None else window
    rows = detections.select(*keys, second, F.lit(1).alias("kind"), window.cast("long").alias("window")).groupBy(*keys, "second", "kind", "window").agg(F.count("*").alias("n"))
    if closings is not None:
        rows = rows.unionByName(closings.select(*keys, second).distinct().select(*keys, "second", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("n")))
    own = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [*keys, "case_no", "opened_s", "updated_s", "events", "dropped", "closed_s"]
        key, case, mark, schema = object(), None, None, None
        for batch in batches:
            schema, done = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                k, (at, kind, window, n) = row[:width], row[width:]
                if k != key:
                    done += [case] if case else []
                    key, case, mark = k, None, None
                if kind == 0:
                    if case and case[-1] is None:
                        case[-1] = at
                elif mark is not None and at - mark < window:
                    if case[-1] is None:
                        case[-3] += n
                        case[-4] = mark = at
                    else:
                        case[-2] += n
                else:
                    done += [case] if case else []
                    case, mark = [*k, 1 + (case[width] if case else 0), at, at, n, 0, None], at
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type if i < width else pa.int64()) for i, c in enumerate(zip(*done))], names=names)
        if case:
            yield pa.RecordBatch.from_arrays([pa.array([c], schema.field(i).type if i < width else pa.int64()) for i, c in enumerate(case)], names=names)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "second", "kind", "window")
    return dealt.mapInArrow(fold, f"{own}, case_no long, opened_s long, updated_s long, events long, dropped long, closed_s long")
