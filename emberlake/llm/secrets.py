"""Operator 1, secret scans (native): patterns for known forms, and windows of high entropy for the rest.

A candidate is a run of 20 or more characters of the token alphabet. A window slides over it one character at
a time; the counts of the characters in the window, and the sum of c * log2(c) over them, are updated for the
character that enters and the one that leaves, which gives the Shannon entropy of each window at a cost that depends
on the window and not on the candidate.
A candidate is reported if a window in a run of one class of characters (hexadecimal, letters with digits, letters of
both cases, or all) reaches the entropy for that class. The allow-list takes out a candidate that it matches in full;
of others it takes out the windows that overlap or touch what it matches.

Edge cases: null text is the empty text (no spans, the hash of the empty string); rows are scanned one by one,
so repeated rows give repeated results; texts of any length are scanned whole; only the id and the text are
read, so other columns can't clash; an empty table gives an empty table. Nothing shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed forms. The letters of the keywords count in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates: runs of the token alphabet, at least a window long.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: name: (runs of its alphabet, what a run must hold, entropy in bits a character that a window must reach).
CLASSES = {
    "hex": (r"[0-9a-f]{20,}", r"^(?=.*[0-9])(?=.*[a-f])", 3.0),
    "upper hex": (r"[0-9A-F]{20,}", r"^(?=.*[0-9])(?=.*[A-F])", 3.0),
    "lower": (r"[a-z0-9]{20,}", r"^(?=.*[0-9])(?=.*[a-z])", 3.5),
    "upper": (r"[A-Z0-9]{20,}", r"^(?=.*[0-9])(?=.*[A-Z])", 3.5),
    "letters": (r"[A-Za-z]{20,}", r"^(?=.*[a-z])(?=.*[A-Z])", 3.9),
    "base64": (CANDIDATE, r"^(?=.*[0-9])(?=.*[A-Z])", 3.7),
}
#: Candidates known not to be secret: identifiers of public formats, phrases of words.
ALLOW = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?-i:[a-z]+([-_/=][a-z]+)*)$"
#: Pieces that are no part of a secret, with the characters that touch them: placeholders, runs of an alphabet or of one character.
PLACEHOLDER = r"(?i)[A-Za-z0-9+/_=-]?(?:example|placeholder|changeme|dummy|0123456789|abcdefghij|(.)\1{7,})[A-Za-z0-9+/_=-]?"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches, each as (start, end, value of the group); code points, end exclusive.

    The text between the matches and the matches themselves come from one pattern, so their lengths add up
    to the places.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("value")))
    pairs = F.zip_with(F.slice(between, 1, F.size(whole)), parts, lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(some: Column, at: Column) -> Column:
        """The matches of a slice that begins at a place."""
        match = lambda a, m: F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["n"]).alias("end"), m["value"].alias("value"))
        return F.aggregate(some, F.struct(at.alias("at"), empty.alias("all")), lambda a, m: F.struct((a["at"] + m["gap"] + m["n"]).alias("at"), F.concat(a["all"], F.array(match(a, m))).alias("all")), lambda a: a["all"])

    def all_placed(pairs: Column) -> Column:
        """In slices of the root of their number, as appending to an array copies it."""
        by = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        slices = F.transform(F.sequence(F.lit(1), F.size(pairs), by), lambda i: F.slice(pairs, i, by))
        length = lambda some: F.aggregate(some, F.lit(0), lambda n, m: n + m["gap"] + m["n"])
        with_ = lambda x: F.transform(x["slices"], lambda some, k: placed(some, F.aggregate(F.slice(x["sizes"], F.lit(1), k), F.lit(0), lambda n, m: n + m)))
        return F.flatten(F.element_at(F.transform(F.array(F.struct(slices.alias("slices"), F.transform(slices, length).alias("sizes"))), with_), 1))

    grown = F.element_at(F.transform(F.array(pairs), all_placed), 1)
    return F.when(F.regexp_count(text, F.lit(pattern)) > 0, grown).otherwise(empty)


#: By how much c * log2(c) grows with the c-th equal character in a window, in units of 1e-12: whole numbers don't drift.
_GROWS = [0] + [round(1e12 * (c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0))) for c in range(1, WINDOW + 1)]


def peak_entropy(value: Column) -> Column:
    """The highest entropy of any window of value; 0 if value is shorter. value is ASCII.

    The state is the window, its sum of c * log2(c) and the least such sum so far. A step takes the count of the
    character that leaves and of the one that enters, and changes the sum for these two alone.
    """
    grows = F.array(*[F.lit(x).cast("long") for x in _GROWS])
    among = lambda c, window: F.octet_length(window) - F.octet_length(F.replace(window, c, F.lit("")))

    def step(a: Column, m: Column) -> Column:
        full = m["out"].isNotNull()
        left = F.when(full, F.substring(a["window"], 2, WINDOW)).otherwise(a["window"])
        s = a["s"] - F.when(full, F.get(grows, among(m["out"], a["window"]))).otherwise(F.lit(0).cast("long"))
        moved = F.struct(left.alias("window"), s.alias("s"))

        def enter(x: Column) -> Column:
            return F.struct(F.concat(x["window"], m["into"]).alias("window"), (x["s"] + F.get(grows, among(m["into"], x["window"]) + 1)).alias("s"))

        entered = F.element_at(F.transform(F.array(moved), enter), 1)
        return F.element_at(F.transform(F.array(entered), lambda x: F.struct(x["window"].alias("window"), x["s"].alias("s"), F.when(F.octet_length(x["window"]) == WINDOW, F.least(a["best"], x["s"])).otherwise(a["best"]).alias("best"))), 1)

    def moves(chars: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("string"), WINDOW), F.slice(chars, 1, F.greatest(F.size(chars) - WINDOW, F.lit(0))))
        return F.zip_with(chars, F.slice(before, F.lit(1), F.size(chars)), lambda into, out: F.struct(into.alias("into"), out.alias("out")))

    most = 1 << 62
    start = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("s"), F.lit(most).cast("long").alias("best"))
    each = F.element_at(F.transform(F.array(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))), moves), 1)
    return F.aggregate(each, start, step, lambda a: F.when(a["best"] < most, F.lit(math.log2(WINDOW)) - a["best"] / F.lit(1e12 * WINDOW)).otherwise(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: counts of the fixed forms, the hash of their spans, all spans, and the candidates' peak entropies."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumns({
        "assign": F.filter(found(F.col("_t"), ASSIGN, 2), lambda m: F.length(m["value"]) >= MIN_ASSIGN),
        # A run that is too short has no longer run within it, so the least length may stand in the pattern.
        "access": found(F.col("_t"), ACCESS.replace("+", f"{{{MIN_ACCESS - 4},}}")),
        "hex": found(F.col("_t"), HEX.replace("+", f"{{{MIN_HEX},}}")),
        "_c": F.filter(found(F.col("_t"), CANDIDATE), lambda m: ~m["value"].rlike(ALLOW)),
    })

    def reached(m: Column) -> Column:
        def secret(piece: Column) -> Column:
            any_ = F.lit(False)
            for runs, must, least in CLASSES.values():
                any_ = any_ | F.exists(F.regexp_extract_all(piece, F.lit(runs), F.lit(0)), lambda v: F.when(v.rlike(must), peak_entropy(v)).otherwise(0.0) >= least)  # noqa: B023
            return any_

        return F.exists(F.split(m["value"], PLACEHOLDER, -1), secret)

    df = df.withColumn("entropy", F.when(F.size("_c") > 0, F.filter("_c", reached)).otherwise(F.col("_c")))
    tagged = lambda n, k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("n"), m["end"].alias("end"), F.lit(k).alias("kind")))
    spans = lambda kinds: F.array_sort(F.concat(*[tagged(n, k) for n, k in enumerate(kinds)]))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return df.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(told(spans(KINDS[:3])), 256).alias("base_sha256"),
        told(spans(KINDS)).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
