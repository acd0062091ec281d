"""Operator 3, quality rules by weak supervision (native).

Rules vote good (1), bad (-1) or abstain (0) on each document. A document is good or bad, which no rule sees for
sure; given that, rules vote independently of each other. Expectation-maximisation over the counts of vote patterns
estimates the share of good documents and how each rule votes on good and on bad ones, so a rule that accuses good
documents loses weight, and several acquittals outvote it. A document is kept if its posterior probability of being
good reaches a half and no base rule fails.

Edge cases: a null or empty text has no words, so it fails the base rule on length; rows that repeat a
doc_id are scored row by row; an empty table gives an empty table; columns of the input that clash with
names made here are not read (only the id and the text are).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import NOT_SPACE, cut, words

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: The most rounds of expectation-maximisation, and the change of the share of good documents at which it ends before.
ROUNDS, SETTLED = 60, 1e-5
#: Where the estimates start: the share of good documents, and P(vote | class) of every rule. It says which class is
#: which. As a prior it weighs WEIGHT times the number of documents, so that no estimate is 0.
SHARE = 0.9
BELIEF = {"good": {1: 0.8, 0: 0.18, -1: 0.02}, "bad": {1: 0.5, 0: 0.2, -1: 0.3}}
WEIGHT = 0.01

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_distinct", "n_letters"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and one struct column `f` of counts over each whole text; everything is local to a row, nothing shuffles."""
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "_w": words(F.col("_t")),
        "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(NOT_SPACE)),
        "_s": F.regexp_replace("_t", r"[^#*$%&|<>\p{Lu}.!?]+", ""),
    })
    df = df.withColumn("_n", F.size("_w"))
    three = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]))
    df = df.withColumn("_g", F.when(F.col("_n") >= 3, three).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_mask", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.expr("shiftleft(1L, length(bin(_n))) - 1")))
    # Windows sorted by hash, each with its place in the low bits: equal windows become neighbours.
    df = df.withColumn("_p", F.when(F.col("_mask").isNotNull(), F.sort_array(F.expr("transform(_g, (x, i) -> (x & ~_mask) | i)"))))
    again = F.expr("filter(_p, (x, k) -> (k > 0 AND _g[int(x & _mask)] = _g[int(_p[k - 1] & _mask)]) OR (k < size(_p) - 1 AND _g[int(x & _mask)] = _g[int(_p[k + 1] & _mask)]))")
    df = df.withColumn("_q", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("_mask")))))
    covered = F.expr("aggregate(_q, named_struct('n', 0L, 'to', 0L), (a, i) -> named_struct('n', a.n + i + 3L - greatest(a.to, i), 'to', i + 3L), a -> a.n)")
    count = lambda kept: F.length(F.regexp_replace("_s", f"[^{kept}]+", "")).cast("long")
    f = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(".!?").alias("n_stops"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    return df.select(*[docs[c] for c in docs.columns], f.alias("f"))


#: name: (condition of a bad vote, condition of a good vote), over the counts; neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.3 * n_words", "n_symbols <= 0.05 * n_words"),
    "letters": ("n_letters < 0.88 * word_chars", "n_letters >= 0.93 * word_chars"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    "lines": ("n_dup_lines > 0.4 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "length": ("word_chars < 3 * n_words OR word_chars > 7.5 * n_words", "word_chars BETWEEN 4.5 * n_words AND 6.5 * n_words"),
    "capitals": ("n_upper > 0.3 * word_chars", "n_upper <= 0.1 * word_chars"),
    "stops": ("n_stops > 0.5 * n_words OR 60 * n_stops < n_words", "n_stops <= 0.25 * n_words AND 40 * n_stops >= n_words"),
    "variety": ("n_distinct * n_distinct < 16 * n_words", "n_distinct >= 0.6 * n_words"),
}


def votes() -> Column:
    """The votes of all rules as one array of tinyint."""
    of = lambda condition: re.sub(r"\b(n_\w+|word_chars)\b", r"f.\1", condition)
    return F.array(*[F.expr(f"CASE WHEN {of(bad)} THEN -1Y WHEN {of(good)} THEN 1Y ELSE 0Y END") for bad, good in RULES.values()])


def base_failed() -> Column:
    return (F.col("f.n_words") < MIN_WORDS) | (100 * F.col("f.n_repeat_words") > 50 * F.col("f.n_words"))


def _p_good(share: float, rates: dict[str, list[dict]]) -> Column:
    """P(good | votes) by the current estimates."""
    weights = [{v: math.log(g[v]) - math.log(b[v]) for v in (-1, 0, 1)} for g, b in zip(rates["good"], rates["bad"], strict=True)]
    total = F.lit(math.log(share) - math.log(1 - share))
    for j, w in enumerate(weights):
        vote = F.col("votes")[j]
        total = total + F.when(vote == 1, w[1]).when(vote == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-total))


def estimate(patterns: DataFrame) -> tuple[float, dict[str, list[dict]]]:
    """Share of good documents, and P(vote | class) of each rule, from (votes, n).

    patterns has at most 3 ** len(RULES) rows whatever the corpus; each round is one aggregation over it, of which
    the driver gets the expected counts, one row.
    """
    k = range(len(RULES))
    share, rates = SHARE, {c: [dict(BELIEF[c]) for _ in k] for c in BELIEF}
    for _ in range(ROUNDS):
        p = {"good": F.col("p"), "bad": 1 - F.col("p")}
        given = [F.sum(F.when(F.col("votes")[j] == v, F.col("n") * p[c]).otherwise(0.0)).alias(f"{c}{j}{v}") for c in BELIEF for j in k for v in (-1, 0, 1)]
        got = patterns.withColumn("p", _p_good(share, rates)).agg(*given).first()
        if got["good00"] is None:
            break
        size = {c: sum(got[f"{c}0{v}"] for v in (-1, 0, 1)) for c in BELIEF}
        prior = WEIGHT * sum(size.values())
        before, share = share, (size["good"] + prior * SHARE) / (sum(size.values()) + prior)
        rates = {c: [{v: (got[f"{c}{j}{v}"] + prior * BELIEF[c][v]) / (size[c] + prior) for v in (-1, 0, 1)} for j in k] for c in BELIEF}
        if abs(share - before) < SETTLED:
            break
    return share, rates


def scored(counted: DataFrame) -> DataFrame:
    """counted (with the struct f) and base_failed, p_good, kept. It is read twice, so hand in a written table."""
    voted = counted.withColumn("votes", votes())
    # Documents that fail the base rules are out anyway and would blur the estimates; their posterior is still given.
    patterns = cut(voted.groupBy("votes").agg(F.count_if(~base_failed()).alias("n")).coalesce(1))
    judged = patterns.select("votes", _p_good(*estimate(patterns.where("n > 0"))).alias("p_good"))
    # At most 3 ** len(RULES) = 6561 rows, whatever the corpus.
    return voted.join(F.broadcast(judged), "votes").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("votes")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, p_good and kept for each row of docs."""
    counted = features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "f")
    out = scored(cut(counted))
    return out.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in FEATURES[:5]], "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = features(docs.select(own, F.col(text_col).alias("text"))).select("row", "f")
    return scored(cut(counted)).where("kept").select("row.*")
