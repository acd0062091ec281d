"""Facts about the environment: observed, materialised, gated, and used against events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def candidates(events: DataFrame, host: Column, ip: Column, user: Column, role: Column, ts_us: Column, source: Column) -> DataFrame:
    """Observations that events suggest: (fact, value, confidence, source, at): a role of the host, an edge host to address, an active identity."""
    fact = lambda key, value, confidence: F.when(key.isNotNull() & value.isNotNull(), F.struct(key.alias("fact"), value.alias("value"), F.lit(confidence).alias("confidence")))
    all_ = F.array_compact(F.array(fact(F.concat(F.lit("role:"), host), role, 0.3), fact(F.concat(F.lit("edge:"), host, F.lit(">"), ip), F.lit("seen"), 0.5), fact(F.concat(F.lit("identity:"), user), F.lit("active"), 0.4)))
    return events.select(F.explode(all_).alias("f"), source.alias("source"), ts_us.alias("at")).select("f.*", "source", "at")


def as_of(df: DataFrame, at_us: int, recorded: str = "at") -> DataFrame:
    """What was recorded up to a time."""
    return df.where(F.col(recorded) <= at_us)


def materialise(observations: DataFrame, transitions: DataFrame, now_us: int, ttl_us: int) -> DataFrame:
    """One row for each fact: its value, state, provenance, and whether values conflict.

    The state is that of the newest transition, else `candidate`. A protected fact (state `blessed`) keeps the value
    that its transition names, and `drift` tells if a newer observation says another. Otherwise the value with the largest
    trust * confidence counts, the newest of equal ones; a tie of different values is a conflict. An unprotected fact
    not seen for ttl_us is retired.
    """
    weight = F.col("trust") * F.col("confidence")
    seen = observations.groupBy("fact", "value").agg(F.max(weight).alias("w"), F.max("at").alias("at"), F.count("*").alias("n"))
    best = seen.groupBy("fact").agg(
        F.max_by(F.struct("value", "w"), F.struct("w", "at", "value")).alias("best"), F.max_by("value", F.struct("at", "value")).alias("newest"),
        F.max("at").alias("last_at"), F.sum("n").alias("observations"), F.max("w").alias("top"),
    )
    ties = seen.join(best.select("fact", "top"), "fact").where("w = top").groupBy("fact").agg(F.count("*").alias("equal"))
    sources = observations.groupBy("fact").agg(F.count_distinct("source").alias("sources"))
    state = transitions.groupBy("fact").agg(F.max_by(F.struct("state", "value"), F.struct("at", "state")).alias("t"))
    out = best.join(ties, "fact").join(sources, "fact").join(state, "fact", "left")
    protected = F.coalesce(F.col("t.state") == "blessed", F.lit(False))
    return out.select(
        "fact",
        F.when(protected, F.col("t.value")).otherwise(F.col("best.value")).alias("value"),
        F.when(~protected & (now_us - F.col("last_at") > ttl_us), "retired").otherwise(F.coalesce("t.state", F.lit("candidate"))).alias("state"),
        (protected & (F.col("newest") != F.col("t.value"))).alias("drift"),
        (~protected & (F.col("equal") > 1)).alias("conflict"), "observations", "sources", "last_at",
    )


def influence(observations: DataFrame, cap: float = 0.8) -> DataFrame:
    """(fact, share, over): the largest trust-weighted share that one source has in a fact."""
    by = observations.groupBy("fact", "source").agg(F.sum(F.col("trust") * F.col("confidence")).alias("w"))
    return by.groupBy("fact").agg((F.max("w") / F.sum("w")).alias("share")).withColumn("over", F.col("share") > cap)


def gate(facts: DataFrame, shares: DataFrame, open_cases: DataFrame, now_us: int, quarantine_us: int = 24 * HOUR_US, observations: int = 5, sources: int = 2, high_impact: tuple[str, ...] = ("role",)) -> DataFrame:
    """facts with the reasons against their promotion; none: promoted. A fact of a host with an open case is held whatever else."""
    df = facts.join(shares.select("fact", "over"), "fact", "left").withColumn("_host", F.regexp_extract("fact", r"^[a-z]+:([^>]*)", 1))
    df = df.join(open_cases.select(F.col("host").alias("_host"), F.lit(True).alias("_open")).distinct(), "_host", "left")
    why = [
        ("open case", F.coalesce("_open", F.lit(False))), ("quarantine", now_us - F.col("first_at") < quarantine_us), ("few observations", F.col("observations") < observations), ("few sources", F.col("sources") < sources),
        ("influence", F.coalesce("over", F.lit(False))), ("analyst", F.substring_index("fact", ":", 1).isin(*high_impact)), ("conflict", F.col("conflict")),
    ]
    return df.withColumn("against", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in why])), ", ")).withColumn("promoted", F.col("against") == "").drop("_host", "_open", "over")


def edge_novelty(events: DataFrame, trusted: DataFrame, host: str, ip: str, least: int) -> DataFrame:
    """Events whose (host, address) isn't a trusted edge, for hosts with at least so many trusted edges."""
    known = trusted.groupBy(host).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(host)
    return events.join(known, host, "left_semi").join(trusted.select(host, ip), [host, ip], "left_anti")


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the largest order, by one aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def superseded(df: DataFrame, id_col: str, by: str) -> DataFrame:
    """Records that no other record names as superseded."""
    return df.join(df.where(F.col(by).isNotNull()).select(F.col(by).alias(id_col)).distinct(), id_col, "left_anti")


def monitored(access: DataFrame, profiles: list[dict]) -> DataFrame:
    """access with the strongest monitoring profile that applies (by level, version, then start) and its multiplier."""
    from emberlake.operators.decisions import MONITORING

    hits = []
    for k, p in enumerate(profiles):
        holds = F.lit(True)
        for c, values in p["when"].items():
            holds = holds & F.lower(F.col(c)).isin([v.lower() for v in values])
        holds = holds & (F.col("us") >= p["from_us"]) & (F.col("us") < p["until_us"])
        hits.append(F.when(holds, F.struct(F.lit(list(MONITORING).index(p["level"])).alias("rank"), F.lit(p["version"]).alias("version"), F.lit(p["from_us"]).alias("from_us"), F.lit(-k).alias("k"), F.lit(p["id"]).alias("id"))))
    df = access.withColumn("_p", F.array_max(F.array_compact(F.array(*hits))))
    return df.select(*access.columns, F.col("_p.id").alias("profile"), F.get(F.array(*[F.lit(m) for m in MONITORING.values()]), F.coalesce("_p.rank", F.lit(0))).alias("multiplier"))


