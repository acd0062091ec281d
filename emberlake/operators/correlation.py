"""Correlation rules: groups of events in a time window that pass a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import in_hours
from emberlake.sources.events import field, micros

DAY_US = 86_400_000_000


def since(events: DataFrame, now: Column, hours: int) -> DataFrame:
    """Events of the half-open window before now."""
    return events.where((F.col("event_ts") >= now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("event_ts") < now))


def burst(events: DataFrame, key: Column, when: Column, least: int) -> DataFrame:
    """Keys with at least so many matching events: count, hosts and last time."""
    return events.where(when).groupBy(key.alias("subject")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.max(micros("event_ts")).alias("last_us")).where(F.col("n") >= least)


def off_hours(events: DataFrame, key: Column, when: Column, least: int, start: int = 6, end: int = 20, tz_hours: int = 0, weekend: bool = True) -> DataFrame:
    """Matching events outside the hours [start, end) of a zone, or at weekends, by key."""
    local = F.col("event_ts") + F.expr(f"INTERVAL {tz_hours} HOURS")
    off = in_hours(F.hour(local), start, end, outside=True)
    off = off | F.dayofweek(local).isin(1, 7) if weekend else off
    return events.where(when & off).groupBy(key.alias("subject")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bulk_lookups(events: DataFrame, who: str, whom: str, least: int) -> DataFrame:
    df = events.select(field(who).alias("subject"), field(whom).alias("target"))
    return df.where("subject IS NOT NULL AND target IS NOT NULL").groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets")).where(F.col("targets") >= least)


def lookups(events: DataFrame, when: Column) -> DataFrame:
    """Matching (user, target) pairs with counts."""
    return events.where(when).groupBy(field("db_user").alias("subject"), field("target_person").alias("target")).agg(F.count("*").alias("n"))


def then(events: DataFrame, key: Column, first: Column, second: Column, least: int) -> DataFrame:
    """Keys with so many first events, then a second one after the last of them: the brute force that succeeded.

    Both sides are conditions on one scan; the first are aggregated before they meet the second.
    """
    df = events.select(key.alias("subject"), "event_ts", "host", first.alias("_a"), second.alias("_b"))
    fails = df.where("_a").groupBy("subject").agg(F.count("*").alias("fails"), F.max("event_ts").alias("last_fail")).where(F.col("fails") >= least)
    return df.where("_b").join(fails, "subject").where("event_ts > last_fail").groupBy("subject", "fails").agg(F.min(micros("event_ts")).alias("success_us"), F.count("*").alias("successes"))


def case_folding(detections: DataFrame, keys: list[str], ts: str, realert_us: int) -> DataFrame:
    """Detections of one key fold to a case until a gap longer than the re-alert window."""
    w = Window.partitionBy(*keys).orderBy(ts)
    opens = F.when(F.col(ts) - F.lag(ts).over(w) <= realert_us, 0).otherwise(1)
    numbered = detections.withColumn("_o", opens).withColumn("case_no", F.sum("_o").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "case_no").agg(F.count("*").alias("events"), F.min(ts).alias("opened_us"), F.max(ts).alias("updated_us"))


#: A rule is a list of (selection, condition on the event), with all selections of one rule joined by a condition on their names.
def sigma(events: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(event_id, rule, level) for every rule that an event meets: all rules in one scan."""
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, (level, cond) in rules.items()]))
    return events.select("event_id", F.explode(hits).alias("h")).select("event_id", "h.rule", "h.level")


def selection(**fields: str | list[str]) -> Column:
    """Keys are columns with a modifier (contains, all, startswith, endswith) after two underscores; lists are alternatives; no case."""
    out = None
    for key, values in fields.items():
        name, _, how = key.partition("__")
        col = F.lower(F.col(name))
        values = [values] if isinstance(values, str) else values
        one = {"": lambda v: col == v, "contains": col.contains, "all": col.contains, "startswith": col.startswith, "endswith": col.endswith}[how]  # noqa: B023
        parts = [one(F.lit(v.lower())) for v in values]
        cond = parts[0]
        for p in parts[1:]:
            cond = cond & p if how == "all" else cond | p
        out = cond if out is None else out & cond
    return out


def condition(text: str, named: dict[str, Column]) -> Column:
    """A condition of a rule over its selections: names, `and`, `or`, `not` and brackets; `and` binds more than `or`."""
    import re

    words = re.findall(r"\(|\)|[\w.*]+", text)

    def term() -> Column:
        word = words.pop(0)
        if word == "not":
            return ~F.coalesce(term(), F.lit(False))
        if word == "(":
            out = either()
            if not words or words.pop(0) != ")":
                raise ValueError(f"a bracket lacks in {text!r}")
            return out
        if word not in named:
            raise ValueError(f"{word!r} isn't a selection of the rule")
        return F.coalesce(named[word], F.lit(False))

    def both() -> Column:
        out = term()
        while words and words[0] == "and":
            words.pop(0)
            out = out & term()
        return out

    def either() -> Column:
        out = both()
        while words and words[0] == "or":
            words.pop(0)
            out = out | both()
        return out

    out = either()
    if words:
        raise ValueError(f"{words[0]!r} isn't expected in {text!r}")
    return out


def rule(detection: dict) -> Column:
    """The condition on an event of a rule's detection part: selections (field|modifier: value or values) and a condition."""
    named = {k: selection(**{f.replace("|contains|all", "__all").replace("|", "__"): v for f, v in sel.items()}) for k, sel in detection.items() if k != "condition"}
    return condition(detection["condition"], named)


#: Bounds of what a structured query may ask for.
LIMITS = {"limit": (1, 200), "k": (1, 500), "candidates": (1, 5000), "hours": (1, 8784)}
MAX_VALUE, MAX_TEXT = 512, 2048


def validated(asked: dict) -> dict:
    """A structured query with its numbers clamped to LIMITS; what can't be one is an error.

    Keys: labels and fields (name: list of values), text, hours, from_us, to_us, and the numbers of LIMITS.
    """
    import re

    out = dict(asked)
    for name, (lo, hi) in LIMITS.items():
        if out.get(name) is not None:
            out[name] = min(max(int(out[name]), lo), hi)
    for part in ("labels", "fields"):
        for key, values in out.get(part, {}).items():
            if not re.fullmatch(r"[A-Za-z0-9_.-]{1,64}", key):
                raise ValueError(f"{key!r} isn't a key")
            for v in values:
                if len(v) > MAX_VALUE or "\0" in v:
                    raise ValueError(f"a value of {key} is too long, or has a zero character")
    text = out.get("text") or ""
    if len(text) > MAX_TEXT or "\0" in text:
        raise ValueError("the text is too long, or has a zero character")
    if out.get("from_us") is not None and out.get("to_us") is not None and out["from_us"] >= out["to_us"]:
        raise ValueError("the window is empty")
    if not (out.get("labels") or out.get("fields") or text.strip() or out.get("hours") or out.get("from_us") is not None):
        raise ValueError("the query asks for nothing")
    return out


def structured(events: DataFrame, asked: dict, now_us: int) -> DataFrame:
    """The newest events that a validated query asks for: one of the values of each label and field, in the window; of a
    relative and an absolute start the later counts."""
    asked, us = validated(asked), micros("event_ts")
    keep = F.lit(True)
    for key, values in asked.get("labels", {}).items():
        keep = keep & F.col(key).isin(values)
    for key, values in asked.get("fields", {}).items():
        keep = keep & field(key).isin(values)
    starts = [x for x in (asked.get("from_us"), now_us - asked["hours"] * 3_600_000_000 if asked.get("hours") else None) if x is not None]
    if starts:
        keep = keep & (us >= max(starts))
    if asked.get("to_us") is not None:
        keep = keep & (us < asked["to_us"])
    return events.where(keep).orderBy(F.desc("event_ts"), "event_id").limit(asked.get("limit") or 200)


#: Common names of fields, and the keys of the bag that they stand for.
COMMON = {
    "destination.ip": "dst_ip", "destination.port": "port", "user.name": "user", "process.name": "process", "process.executable": "exe", "process.command_line": "cmdline",
    "process.pid": "pid", "dns.question.name": "dns", "event.action": "event_type", "network.community_id": "community_id", "source.ip": "src_ip", "source.address": "src_ip",
}


def named(events: DataFrame) -> DataFrame:
    """events with the common names beside their own columns, so that rules written for either find them; a port's side isn't known, so there is no source.port."""
    return events.withColumns({**{name: field(key) for name, key in COMMON.items()}, "host.name": F.col("host"), "host.hostname": F.col("host")})
