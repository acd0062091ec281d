"""Operator 8, benchmark decontamination by spaced seeds (native).

Texts are split to lower-cased runs of letters and digits. A mask names the token positions that count; the
hash of those tokens is a seed. Seeds of all positions of the documents meet the seeds of the benchmark, and
each hit fixes how an item lies along a document. There the tokens are compared one by one: the item is found
if a window of WINDOW tokens (or the whole item, if shorter) has at most SUBSTITUTED tokens that differ (one in
an item shorter than WINDOW). The masks meet every such window, whichever tokens differ: MASKS was searched for
that, and a test goes through all cases. Items of fewer than SHORTEST tokens are found where all of their tokens
follow one another in a document: the seed is then a hash of the whole item.

A hit is left out if the positions before it, in both texts, have the same seeds as its own (equal tokens in a row): these hit on the same diagonal.
Hits are gathered to the distinct diagonals of a document and an item, and each of these is compared once, when the documents with
hits are read again. The benchmark's seeds and the gathered hits are broadcast up to a bound; beyond, they are joined by a shuffle.

Edge cases: null and empty texts have no tokens; rows that share an id and a text decide alike, and give one
result row; a null id is an id of its own in the filter and null in the result; repeated items count once;
texts are read whole; empty tables give empty results; only the ids and the texts are read, and other columns, whatever
their names, are handed on by the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import cut

#: Token positions that count.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7))
WINDOW, SUBSTITUTED, SHORTEST = 13, 2, 8
BROADCAST_SEEDS = 500_000
#: Keys of documents to leave out, and diagonals of hits (8 bytes each), are broadcast up to so many.
BROADCAST_KEYS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _hashed(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    """(id, key, h): key stands for the id and the text together."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(F.col(id_col).alias(f"{prefix}_id"), F.xxhash64(F.col(id_col), text).alias(f"{prefix}_key"), tokens(text).alias("_t"))
    return split.where(F.size("_t") > 0).select(f"{prefix}_id", f"{prefix}_key", F.transform("_t", lambda t: F.xxhash64(t)).alias(f"{prefix}_h"))


def _seeds(df: DataFrame, prefix: str, short: list[int], *keep: str) -> DataFrame:
    """One row for each position and mask: the columns to keep, the position, the seed and whether the position before has the same; short: lengths of items that are seeds as a whole."""
    h, p, n = F.col(f"{prefix}_h"), F.col("p"), F.size(F.col(f"{prefix}_h"))
    at = df.select(*keep, f"{prefix}_h", F.explode(F.sequence(F.lit(0), n - 1)).alias("p"))
    masks = [*enumerate(MASKS), *((-k, tuple(range(k))) for k in short)]
    seed = [F.when((p + m[-1] < n) & (n >= SHORTEST if k >= 0 else F.lit(True)), F.xxhash64(F.lit(k), *[F.get(h, p + i) for i in m])) for k, m in masks]
    again = [reduce(Column.__and__, [F.get(h, p + i) == F.get(h, p + i - 1) for i in m], p > 0) if k >= 0 else F.lit(False) for k, m in masks]
    # No lambda here: it would take the step out of generated code, and each position would then copy the whole array of hashes.
    each = F.array(*[F.struct(x.alias("seed"), F.coalesce(y, F.lit(False)).alias(f"{prefix}_again")) for x, y in zip(seed, again)])
    return at.select(*keep, p.alias(f"{prefix}_p"), F.inline(each)).where("seed IS NOT NULL")


def _matched(doc: Column, item: Column, diags: Column) -> Column:
    """Tokens that agree on the best of the diagonals on which the item is found; null if it is on none."""
    w = F.least(F.size(item), F.lit(WINDOW))
    allowed = F.when(w < SHORTEST, 0).when(w < WINDOW, 1).otherwise(SUBSTITUTED)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    same = lambda diag: F.transform(item, lambda t, k: F.when(F.get(doc, diag + k) == t, 1).otherwise(0))
    found = lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - w + 1), lambda i: total(F.slice(s, i, w)) >= w - allowed)
    return F.array_max(F.flatten(F.transform(diags, lambda d: F.transform(F.array(same(d)), lambda s: F.when(found(s), total(s))))))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, doc_key, item_id, matched and item_tokens for each document and each item found in it."""
    items = _hashed(benchmark, item_col, item_text_col, "item").dropDuplicates(["item_key"])
    short = sorted(r[0] for r in items.select(F.size("item_h").alias("n")).where(F.col("n") < SHORTEST).distinct().collect())  # SHORTEST - 1 at most
    whole = [(F.size("item_h") == n, n) for n in short]
    long_ones = _seeds(items.where(F.size("item_h") >= SHORTEST), "item", [], "item_key")
    seeds = reduce(DataFrame.union, [items.where(is_n).select("item_key", F.lit(0).alias("item_p"), F.xxhash64(F.lit(-n), *[F.get("item_h", F.lit(i)) for i in range(n)]).alias("seed"), F.lit(False).alias("item_again")) for is_n, n in whole], long_ones)
    given = _hashed(docs, id_col, text_col, "doc")
    few_seeds = seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    hits = _seeds(given, "doc", short, "doc_key").join(F.broadcast(seeds) if few_seeds else seeds, "seed").where("NOT (doc_again AND item_again)")
    hits = cut(hits.groupBy("doc_key", "item_key").agg(F.collect_set(F.col("doc_p") - F.col("item_p")).alias("diags")))
    few = (hits.agg(F.sum(F.size("diags") + 1)).first()[0] or 0) <= BROADCAST_KEYS  # then no text moves
    lain = given.join(F.broadcast(hits) if few else hits, "doc_key").join(F.broadcast(items) if few_seeds else items, "item_key")
    found = lain.withColumn("matched", _matched(F.col("doc_h"), F.col("item_h"), F.col("diags")).cast("long")).where("matched IS NOT NULL")
    found = found.groupBy("doc_id", "doc_key", "item_id", F.size("item_h").cast("long").alias("item_tokens")).agg(F.max("matched").alias("matched"))
    return found.select("doc_id", "doc_key", "item_id", "matched", "item_tokens")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those in which an item is found."""
    dirty = cut(overlaps(docs.select(id_col, text_col), benchmark, id_col, text_col, item_col, item_text_col).select("doc_key").distinct())
    few = dirty.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS  # then no text moves
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("doc_key"))
    return given.join(F.broadcast(dirty) if few else dirty, "doc_key", "left_anti").select("row.*")
