"""Current records, risk, policies, detectors and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import level_weight

#: Effects of policies, from the weakest to the strongest.
EFFECTS = ("allow", "increase_risk", "alert", "step_up_review", "require_justification", "require_approval", "deny")
#: What satisfies an effect that asks for something: the column that tells whether it is there.
MET_BY = {"require_justification": "justified", "require_approval": "approved"}
#: Levels of monitoring, from the weakest to the strongest, and by how much each raises attention.
MONITORING = {"normal": 1.0, "watched": 1.25, "elevated": 1.5, "investigation": 2.0, "restricted": 2.5}
LEVELS = ("informational", "low", "medium", "high", "critical")


def current(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, by one aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def trust(cases: DataFrame, outcomes: DataFrame, decisions: DataFrame, predictions: DataFrame) -> DataFrame:
    """case_id, disposition and how it is known: outcome, then the analyst's decision, then the prediction."""
    out = cases
    for name, df in (("outcome", outcomes), ("decision", decisions), ("prediction", predictions)):
        out = out.join(current(df, "case_id", ["created_us", "id"]).select("case_id", F.col("disposition").alias(name)), "case_id", "left")
    basis = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in ("outcome", "decision", "prediction")], F.lit("unresolved"))
    return out.withColumn("basis", basis).withColumn("disposition", F.coalesce("outcome", "decision", "prediction")).drop("outcome", "decision", "prediction")


def multiplier(disposition: Column) -> Column:
    """What a case counts for by its disposition; half for one that isn't judged."""
    return F.when(disposition == "malicious", 2.0).when(disposition.isin("suspicious", "needs_human"), 1.0).when(disposition == "benign", 0.0).otherwise(0.5)


def risk(cases: DataFrame, subject: str, now_us: int, half_life_h: float = 24.0, max_age_h: float = 72.0, discount: float = 0.5, threshold: float = 10.0, top: int = 5) -> DataFrame:
    """Sum of level weight, multiplier and exponential decay over the cases of each subject.

    The age is that since the last update, in whole seconds, and none is below 0. Cases that the score itself has raised
    (rule `risk-...`), those older than max_age_h, and those that count nothing (benign) are left out. With the score come
    the number of cases that count, the top contributors, and the attack techniques of all.
    """
    age = F.greatest(F.expr(f"({now_us} - updated_us) div 1000000") / 3600.0, F.lit(0.0))
    name = F.trim(F.col(subject).cast("string"))
    judged = multiplier(F.col("disposition")) * F.when(F.col("basis") == "prediction", min(max(discount, 0.0), 1.0)).otherwise(1.0)
    part = level_weight(F.col("level")) * judged * F.pow(F.lit(0.5), F.col("age") / half_life_h)
    df = cases.where(~F.col("rule").startswith("risk-")).select(name.alias("subject"), "case_id", age.alias("age"), "level", "disposition", "basis", F.col("attack") if "attack" in cases.columns else F.array().cast("array<string>").alias("attack"))
    df = df.where("subject <> ''").where(F.col("age") <= max_age_h).withColumn("part", part).where("part > 0")
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("part"), "case_id"))
    tops = df.select("subject", "case_id", "part").withColumn("place", place).where(F.col("place") <= top).groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "case_id"))), lambda x: x["case_id"]).alias("contributors"))
    attack = df.select("subject", F.explode("attack").alias("a")).distinct().groupBy("subject").agg(F.array_sort(F.collect_set("a")).alias("attack"))  # the techniques of a catalog
    out = df.groupBy("subject").agg(F.sum("part").alias("score"), F.count("*").alias("cases")).where(F.col("score") >= threshold)
    out = out.withColumn("level", F.when(F.col("score") >= 2 * threshold, "critical").otherwise("high"))
    return out.join(tops, "subject").join(attack, "subject", "left").withColumn("attack", F.coalesce("attack", F.array().cast("array<string>")))


def band(score: Column) -> Column:
    return F.when(score >= 13, "critical").when(score >= 8, "high").when(score >= 4, "medium").when(score >= 2, "low").otherwise("informational")


def stronger(a: Column, b: Column) -> Column:
    """The stronger of two levels."""
    at = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return F.when(at(a) >= at(b), a).otherwise(b)


def ensemble(signals: DataFrame, key: str, crit_coef: float = 1.0, corr_coef: float = 0.25) -> DataFrame:
    """Signals of one event scored: the largest weight, raised by criticality, the number of signals and attention (where
    there are columns `criticality` and `attention`); a band, and a level that is never below the strongest signal's."""
    has = lambda c, other: F.max(F.coalesce(F.col(c), F.lit(other))) if c in signals.columns else F.lit(other)
    agg = signals.groupBy(key).agg(F.max(level_weight(F.col("level"))).alias("base"), F.count_distinct("detector").alias("n"), has("criticality", 0.0).alias("crit"), has("attention", 1.0).alias("attention"), F.max(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))).alias("floor"))
    score = F.col("base") * (1 + crit_coef * F.col("crit")) * (1 + corr_coef * (F.col("n") - 1)) * F.greatest(F.lit(1.0), F.col("attention"))
    out = agg.withColumn("score", score).withColumn("band", band(F.col("score")))
    return out.withColumn("level", stronger(F.col("band"), F.element_at(F.array(*map(F.lit, LEVELS)), F.col("floor").cast("int")))).select(key, "n", "score", "band", "level")


def fuse_findings(findings: DataFrame, key: str, apart: list[str]) -> DataFrame:
    """Findings (key, detector, level, criticality, attack) of one event: those of detectors that stand apart pass one by one, the
    rest become one finding, named by its band, with the union of the attack techniques."""
    scored = lambda df, k: ensemble(df, k)
    alone = findings.where(F.col("detector").isin(apart)).withColumn("_k", F.struct(key, "detector"))
    one = scored(alone, "_k").select(F.col(f"_k.{key}").alias(key), F.col("_k.detector").alias("detector"), "n", "score", "level")
    weak = findings.where(~F.col("detector").isin(apart))
    attack = findings.withColumn("detector", F.when(F.col("detector").isin(apart), F.col("detector"))).groupBy(key, "detector").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("attack")))).alias("attack"))  # the signals of one event
    many = scored(weak, key).select(key, F.concat(F.lit("combined-"), "band").alias("detector"), "n", "score", "level")
    with_attack = lambda df, name: df.join(attack.withColumnRenamed("detector", "_d"), (df[key] == attack[key]) & F.col("_d").eqNullSafe(name)).select(df[key], df["detector"], "n", "score", "level", "attack")
    return with_attack(one, F.col("detector")).unionByName(with_attack(many, F.lit(None).cast("string")))


def object_matches(pattern: str, name: Column) -> Column:
    """Exact, a prefix before `.*`, or a bare name against the last part; no case."""
    p, low = pattern.lower(), F.lower(name)
    if p.endswith(".*"):
        return (low == p[:-2]) | low.startswith(p[:-1])
    return (low == p) | (F.substring_index(low, ".", -1) == p) if "." not in p else low == p


def policies(access: DataFrame, rules: list[dict]) -> DataFrame:
    """The strongest effect of the policies that apply to each access, and the policy; policies become one expression.

    A rule has id, effect, priority, and conditions by column: a list of values, or a pattern for `object`. An
    effect that asks for a justification or an approval is met by one, and then allows. Ties go to the higher priority,
    then to the first. `missing` lists what the policies that apply ask for and don't get.
    """
    hits, asked = [], {}
    for k, r in enumerate(rules):
        conds = [object_matches(v, F.col(c)) if c == "object" else F.lower(F.col(c)).isin([x.lower() for x in v]) for c, v in r["when"].items()]
        holds, met = reduce(lambda a, b: a & b, conds, F.lit(True)), F.lit(False)
        if r["effect"] in MET_BY:
            met = F.coalesce(F.col(MET_BY[r["effect"]]), F.lit(False))
            asked[r["effect"]] = asked.get(r["effect"], F.lit(False)) | (holds & ~met)
        rank = F.when(met, 0).otherwise(EFFECTS.index(r["effect"]))
        hits.append(F.when(holds, F.struct(rank.alias("rank"), F.lit(r["priority"]).alias("priority"), F.lit(-k).alias("order"), F.lit(r["id"]).alias("id"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    return access.withColumn("_p", best).select(*access.columns, F.when(F.col("_p").isNull(), "allow").otherwise(F.get(F.array(*map(F.lit, EFFECTS)), F.col("_p.rank"))).alias("effect"), F.col("_p.id").alias("policy"), F.array_join(F.array_compact(F.array(*[F.when(asked[e], e.removeprefix("require_")) for e in sorted(asked)] or [F.lit(None).cast("string")])), ",").alias("missing"))


def simulate(decided: DataFrame, samples: int = 20) -> DataFrame:
    """Counts for each effect, with the users and objects that it touches, how many of them are restrictive on a justified
    access (likely false positives), and the first samples by event."""
    restrictive = ~F.col("effect").isin("allow", "increase_risk")
    counts = decided.groupBy("effect").agg(F.count("*").alias("n"), F.count_distinct("db_user").alias("users"), F.count_distinct("object").alias("objects"), F.count_if(restrictive & F.col("justified")).alias("likely_false"))
    some = decided.withColumn("_k", F.row_number().over(Window.partitionBy("effect").orderBy("event_id"))).where(F.col("_k") <= samples)
    return counts.join(some.groupBy("effect").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("samples")), "effect")


def detect(df: DataFrame, key: str, detectors: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, detector, level) of each condition that a row meets."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("detector"), F.lit(level).alias("level"))) for n, (level, c) in detectors.items()]))
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.*")


def classification_criticality(c: Column) -> Column:
    return F.when(c == "secret", 1.0).when(c == "restricted", 0.8).when(c == "confidential", 0.6).when(c == "internal", 0.2).when(c == "public", 0.0).otherwise(0.4)


def confusion(df: DataFrame, truth: Column, alert: Column, score: Column, budget: int, key: str = "id") -> DataFrame:
    """One row: confusion counts, precision, recall (0 where there is nothing to divide by), Brier score of the score clamped
    to 0..1, and precision among the alerts with the highest scores, up to the budget. A false negative is a dangerous miss."""
    t, a, p = truth.cast("int"), alert.cast("int"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    one = df.agg(F.count("*").alias("rows"), F.sum(t * a).alias("tp"), F.sum((1 - t) * a).alias("fp"), F.sum(t * (1 - a)).alias("fn"), F.sum((1 - t) * (1 - a)).alias("tn"), F.avg(F.pow(p - t, F.lit(2))).alias("brier"))
    top = df.where(alert).select(t.alias("t"), score.alias("s"), key).orderBy(F.desc("s"), key).limit(budget).agg(F.coalesce(F.avg("t"), F.lit(0.0)).alias("precision_at_budget"))
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    return one.crossJoin(F.broadcast(top)).withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))  # one row each


def promotable(champion: DataFrame, challenger: DataFrame, least_rows: int = 5, least_dangerous: int = 1, more_missed: int = 0) -> DataFrame:
    """One row: by how much a challenger differs from the champion (both from confusion), and the reasons against it."""
    c, n = champion.select(*[F.col(x).alias(f"c_{x}") for x in champion.columns]), challenger
    df = n.crossJoin(F.broadcast(c))  # one row each
    why = [("few rows", F.col("rows") < least_rows), ("few dangerous rows", F.col("tp") + F.col("fn") < least_dangerous), ("more dangerous misses", F.col("fn") - F.col("c_fn") > more_missed)]
    against = F.array_join(F.array_compact(F.array(*[F.when(x, F.lit(w)) for w, x in why])), ", ")
    return df.select((F.col("fn") - F.col("c_fn")).alias("missed_delta"), (F.col("precision") - F.col("c_precision")).alias("precision_delta"), (F.col("recall") - F.col("c_recall")).alias("recall_delta"), against.alias("against"), (against == "").alias("promotable"))


def shadow(champion: DataFrame, challenger: DataFrame, key: str) -> DataFrame:
    """One row of counts: events scored, those on which two sets of detectors differ, what each finds alone, dangerous misses
    (events on which the challenger drops a detector of level high or critical), and the advice.

    champion has (key, found: array of detector, level); challenger (key, found: array of detector)."""
    names = F.array_distinct(F.transform("c.found", lambda x: x["detector"]))
    df = champion.alias("c").join(challenger.alias("n"), key, "left").select(names.alias("c"), F.coalesce("n.found", F.array().cast("array<string>")).alias("n"), F.col("c.found").alias("found"))
    gone, new = F.array_except("c", "n"), F.array_except("n", "c")
    missed = F.exists("found", lambda x: F.array_contains(F.col("gone"), x["detector"]) & x["level"].isin("high", "critical"))
    df = df.select(gone.alias("gone"), new.alias("new"), "found").withColumn("missed", missed)
    out = df.agg(F.count("*").alias("events"), F.count_if((F.size("gone") > 0) | (F.size("new") > 0)).alias("differ"), F.sum(F.size("gone")).alias("champion_only"), F.sum(F.size("new")).alias("challenger_only"), F.count_if("missed").alias("dangerous"))
    advice = F.when(F.col("events") == 0, "none").when(F.col("dangerous") > 0, "reject").when(F.col("champion_only") > 0, "review").when(F.col("challenger_only") > 0, "promote").otherwise("neutral")
    return out.withColumn("advice", advice)


def lessons(mistakes: DataFrame, decisions: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """(category, support): mistakes by category over distinct sources, of cases whose current decision corrects the prediction, and
    of no case; missed evidence also counts the cases whose decision says so."""
    now = current(decisions, "case_id", ["created_us", "id"])
    corrected = now.where("prediction_correct = false OR evidence_missed").select("case_id")
    own = mistakes.where("case_id IS NULL").select("category", F.concat(F.lit("mistake:"), F.col("mistake_id").cast("string")).alias("source"))
    on = mistakes.where("case_id IS NOT NULL").join(corrected, "case_id", "left_semi").select("category", F.col("case_id").cast("string").alias("source"))
    missed = now.where("evidence_missed").select(F.lit("missed_evidence").alias("category"), F.col("case_id").cast("string").alias("source"))
    out = own.union(on).union(missed).groupBy("category").agg(F.count_distinct("source").alias("support")).where(F.col("support") >= least)
    return out.orderBy(F.desc("support"), "category").limit(top)


def verdicts(cases: DataFrame) -> DataFrame:
    """(expected, actual, n, over, under, injected) of judged golden cases: the confusion counts with over- and under-triggering."""
    order = F.array(*map(F.lit, ("benign", "needs_human", "suspicious", "malicious")))
    rank = lambda c: F.array_position(order, F.col(c))
    return cases.groupBy("expected", "actual").agg(F.count("*").alias("n"), F.count_if(rank("actual") > rank("expected")).alias("over"), F.count_if(rank("actual") < rank("expected")).alias("under"), F.count_if(F.col("injection") & (rank("actual") < rank("expected"))).alias("injected"))


def coverage(rules: DataFrame) -> DataFrame:
    """(technique, rules): rules for each technique of the attack catalog; tags and chains `A->B` count, if they are techniques."""
    each = rules.select("rule", F.explode(F.flatten(F.transform("attack", lambda a: F.split(a, "->")))).alias("t")).select("rule", F.upper(F.trim("t")).alias("technique"))
    return each.where(F.col("technique").rlike(r"^T\d+(\.\d+)?$")).groupBy("technique").agg(F.count_distinct("rule").alias("rules"))


def service_clocks(cases: DataFrame, now_us: int, ack_us: int, resolve_us: int) -> DataFrame:
    """cases with the deadlines that run (null where none does) and whether they are past.

    The first runs while a case waits for a person and nobody owns it, from its last change of state; the second from
    opening until it is closed.
    """
    waits = F.col("state").isin("needs_human", "escalated") & F.col("assignee").isNull()
    ack = F.when(waits & F.lit(ack_us > 0), F.coalesce("changed_us", "opened_us") + ack_us)
    end = F.when((F.col("state") != "closed") & F.lit(resolve_us > 0), F.col("opened_us") + resolve_us)
    return cases.select(*cases.columns, ack.alias("ack_by"), F.coalesce(F.lit(now_us) >= ack, F.lit(False)).alias("ack_late"), end.alias("resolve_by"), F.coalesce(F.lit(now_us) >= end, F.lit(False)).alias("resolve_late"))


def quantile_cuts(df: DataFrame, ts: str, shares: list[float], width: int) -> list[int]:
    """The values below which the shares of all rows lie (linear between neighbours, floored), exactly.

    Counts by bucket of width give the bucket that holds each rank; only the rows of those buckets are counted by value.
    The driver gets the counts of buckets (the span of values by width) and a pair of values for each share.
    """
    by = df.groupBy(F.expr(f"{ts} div {width}").alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    total, cuts = sum(r["n"] for r in by), []
    for q in shares:
        rank = q * (total - 1)
        at, values = int(rank), []
        for k in sorted({at, min(at + 1, total - 1)}):
            before, bucket = 0, None
            for r in by:
                if before + r["n"] > k:
                    bucket = r["b"]
                    break
                before += r["n"]
            counts = df.where(F.expr(f"{ts} div {width} = {bucket}")).groupBy(ts).agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))  # one bucket's values
            values.append(counts.withColumn("upto", upto).where(F.col("upto") > k - before).agg(F.min(ts)).first()[0])
        cuts.append(int(values[0] + (values[-1] - values[0]) * (rank - at)))
    return cuts


def temporal_split(df: DataFrame, ts: str, train: float = 0.7, valid: float = 0.15, width: int = 60_000_000) -> DataFrame:
    """Rows with the part that their time falls in; the cuts are exact percentiles of time, and no task holds all times."""
    a, b = quantile_cuts(df, ts, [train, train + valid], width)
    return df.withColumn("part", F.when(F.col(ts) <= a, "train").when(F.col(ts) <= b, "valid").otherwise("test"))
