"""Operator 6, fuzzy line dedup by MinHash (native).

Lines that aren't blank, lower-cased and trimmed, are compared over the whole corpus. Equal lines meet by hash.
Distinct lines get a MinHash signature of their EXACT-character shingles, at every character: each is hashed
once, to 64 bits; a minimum of the signature is the least value of that hash, rotated and under an exclusive-or mask.
ROWS of the minima make a band key (each minimum serves in two bands). Lines in one bucket are candidates; their full
sets of shingles (as hashes of 64 bits) decide, at a Jaccard similarity of THRESHOLD. Components of the links come from a distributed
union-find, and of each component the line that is first, by document id and line number, stays.

Candidates: each line meets the most central line of each of its buckets (its hubs); of those that may be near by their
minima it is compared with the most central one. Then, in buckets whose lines are still in several components, the lines outside the bucket's largest component
meet those of other components, but for pairs that can't be links: those whose low bits of minima agree too seldom
(FAR_OFF standard deviations below the threshold), and those of one hub whose differences from it rule a link out
(common.may_reach, which loses none). In a large group of variants of one line nearly all pairs are of the latter kind,
so copies and variants cost about their number and not its square in rows.
A pair at the threshold shares no bucket with a probability of 2.3e-3 (0.2e-3 at 0.85), whatever its script, words or length.

Edge cases: a null text stays null and has no lines; lines of rows without id stay; rows that share an id count
as one document, so their equal lines with equal numbers tie and all stay; a line shorter than a shingle is one
itself, so it meets equal lines alone; blank lines stay; texts are read whole; an empty table gives an empty table;
other columns are handed on, whatever their names.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import against_hub, bits_for, components, cut, enough, may_reach, nibbles_agreeing, release

EXACT, THRESHOLD = 5, 0.8
MINIMA, ROWS, BANDS = 50, 5, 20
LONGS = -(-MINIMA // 16)
FAR_OFF = 5.0
#: Steps that the bands are dealt in.
SHARES = 2
#: Ids (8 bytes each) are broadcast up to so many, else joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Shingles in a row that the minima are taken of: a minimum over rows costs several times the comparison within one.
BLOCK = 8
#: Minima under one rotation see the same order of bits; several keep them apart in short lines too.
ROTATIONS = 8

_bits = random.Random(20240203)
MASKS = [_bits.getrandbits(63) for _ in range(MINIMA)]
_deck = _bits.sample(range(MINIMA), MINIMA) + _bits.sample(range(MINIMA), MINIMA)
#: The minima of each band.
BAND = [_deck[ROWS * j : ROWS * (j + 1)] for j in range(BANDS)]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, i, line, a, b): lines that aren't blank with their place and a hash of 128 bits."""
    each = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text_col, "\n", -1)).alias("i", "line"))
    each = each.where(F.col("line").rlike(r"\S")).select("doc", "i", F.lower(F.trim("line")).alias("line"))
    return each.select("doc", "i", "line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def signatures(found: DataFrame) -> DataFrame:
    """(a, bits, keys) for each distinct line: the low 4 bits of its minima, packed, and its band keys of 32 bits."""
    u, p, last = F.col("u"), F.col("p"), F.col("last")
    # Each distinct line once; what follows keeps this grouping, so only the lines are shuffled.
    at = found.groupBy("a", "b").agg(F.min("line").alias("line")).select("a", "b", F.encode("line", "UTF-32").alias("u"))
    at = at.select("*", F.greatest((F.octet_length(u) / 4).cast("int") - EXACT, F.lit(0)).alias("last"))
    at = at.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK))).alias("p"))
    # A row has BLOCK shingles, beyond the end the last one again; the minima of a line take the least of each row.
    hashed = at.select("a", "b", *[F.xxhash64(F.substring(u, 4 * F.least(p + i, last) + 1, F.lit(4 * EXACT))).alias(f"h{i}") for i in range(BLOCK)])
    hash_ = [F.col(f"h{i}") for i in range(BLOCK)]
    turned = [[h if r == 0 else F.shiftleft(h, 64 // ROTATIONS * r).bitwiseOR(F.shiftrightunsigned(h, 64 - 64 // ROTATIONS * r)) for h in hash_] for r in range(ROTATIONS)]
    least = hashed.groupBy("a", "b").agg(*[F.min(F.least(*[h.bitwiseXOR(mask) for h in turned[k % ROTATIONS]])).alias(f"m{k}") for k, mask in enumerate(map(F.lit, MASKS))])
    # No minimum is null. Where Spark knows that, the code that it makes below is short enough for the JVM to compile (8,000 bytes of a method).
    least = least.where(reduce(Column.__and__, [F.col(f"m{k}").isNotNull() for k in range(MINIMA)]))
    nibble = lambda k: F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(15)), 4 * (k % 16))
    packed = [reduce(lambda x, y: x.bitwiseOR(y), [nibble(k) for k in range(16 * n, min(16 * n + 16, MINIMA))]) for n in range(LONGS)]
    keys = F.array(*[F.hash(F.lit(j), *[F.col(f"m{k}") for k in ks]) for j, ks in enumerate(BAND)])
    return least.select("a", F.array(*packed).alias("bits"), keys.alias("keys"))


def agree(x: Column, y: Column) -> Column:
    """False only (but for FAR_OFF standard deviations) for lines that don't reach the threshold."""
    return nibbles_agreeing(x, y, LONGS, MINIMA) >= bits_for(THRESHOLD, MINIMA, FAR_OFF)


def shingles(line: Column) -> Column:
    """The hashes of the distinct character shingles of a line; a shorter line is one itself."""
    last = lambda u: F.greatest((F.octet_length(u) / 4).cast("int") - EXACT, F.lit(0))
    # A list of one line binds its code points to a name, so that they are made once.
    each = F.transform(F.array(F.encode(line, "UTF-32")), lambda u: F.array_distinct(F.transform(F.sequence(F.lit(0), last(u)), lambda p: F.xxhash64(F.substring(u, 4 * p + 1, F.lit(4 * EXACT))))))
    return F.element_at(each, 1)


def compared(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, maps: bool = True) -> DataFrame:
    """pairs (x, y) of lines with `rel`, how the shingles of y differ from those of x, or its sizes alone; pairs is a written table.

    Lines meet as text, and their sets are made where they meet: a set is many times its line.
    """
    ids = cut(pairs.select(F.col("x").alias("a")).union(pairs.select("y")).distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = lines(docs, id_col, text_col).select("a", "line").join(F.broadcast(ids) if few else ids, "a", "left_semi").groupBy("a").agg(F.min("line").alias("line"))
    texts = cut(texts)
    of = lambda c: texts.select(F.col("a").alias(c), F.col("line").alias(f"line_{c}"))
    met = pairs.select("x", "y").join(of("y"), "y").join(of("x"), "x")
    sets = F.array(F.struct(shingles(F.col("line_x")).alias("x"), shingles(F.col("line_y")).alias("y")))
    sizes = lambda s: F.struct(F.size(s["y"]).alias("n"), F.size(s["x"]).alias("n_hub"), F.size(F.array_intersect(s["y"], s["x"])).alias("both"))
    return met.select("x", "y", F.element_at(F.transform(sets, lambda s: against_hub(s["y"], s["x"]) if maps else sizes(s)), 1).alias("rel"))


def central(bucket: DataFrame) -> DataFrame:
    """(key, hub, met): of each bucket (key, a, m lines) the line that meets most others over all buckets, and how many.

    Variants of one line are nearer to it than to each other, so that line, if it is there, meets most and all of
    its variants are compared with it.
    """
    meets = bucket.groupBy("a").agg(F.sum("m").alias("met"))
    return bucket.join(meets, "a").groupBy("key").agg(F.max(F.struct("met", "a")).alias("h")).select("key", F.col("h.a").alias("hub"), F.col("h.met").alias("met"))


def linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the distinct lines that are linked with others, by hash."""
    keyed = cut(signatures(lines(docs, id_col, text_col)))
    release(docs.sparkSession)
    # A share of the bands at a time, so that the disk holds the exchange of no more than that share.
    shares = []
    for k in range(SHARES):
        many = BANDS // SHARES
        # One shuffle by key serves the count of each bucket and the join back. A key is the number of its band and its 32 bits.
        each = keyed.select("a", F.posexplode(F.slice("keys", 1 + k * many, many)).alias("band", "short"))
        each = each.select("a", ((F.col("band").cast("long") + k * many) * (1 << 32) + F.col("short")).alias("key")).repartition("key")
        # The count names a, so that both readers of the exchange want the same columns and it is reused.
        shared = each.groupBy("key").agg(F.count("a").alias("m")).where("m > 1")
        shares.append(cut(each.join(shared.hint("shuffle_hash"), "key").select("key", "a", "m")))
        del each, shared
        release(docs.sparkSession)
    bucket = reduce(DataFrame.union, shares)
    some = cut(keyed.join(bucket.select("a").distinct(), "a", "left_semi"))
    of = lambda c: some.select(F.col("a").alias(c), F.col("bits").alias(f"bits_{c}"))

    met = bucket.join(central(bucket), "key").where("a <> hub").select(F.col("hub").alias("x"), F.col("a").alias("y"), "met").distinct()
    may = met.join(of("y"), "y").join(of("x"), "x").where(agree(F.col("bits_x"), F.col("bits_y")))
    # The most central of the hubs that may be near, so that a group of variants has one hub in common.
    tree = cut(may.groupBy("y").agg(F.max_by("x", F.struct("met", "x")).alias("x")).select("x", "y"))
    near = cut(compared(tree, docs, id_col, text_col))
    release(docs.sparkSession)
    tied = near.where(enough(F.col("rel.both"), F.col("rel.n"), F.col("rel.n_hub"), THRESHOLD)).select(F.col("x").alias("a"), F.col("y").alias("b"))

    groups = cut(components(tied))
    release(docs.sparkSession)
    placed = cut(bucket.join(groups, bucket["a"] == groups["node"], "left").select("key", "a", F.coalesce("component", "a").alias("c")))
    mixed = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    known = some.join(near.select(F.col("y").alias("a"), F.col("x").alias("hub"), "rel"), "a", "left")
    open_ = cut(placed.join(mixed, "key").join(known, "a"))
    side = lambda z: open_.select("key", "main", F.col("a").alias(z), *[F.col(k).alias(f"{k}_{z}") for k in ("c", "bits", "keys", "hub", "rel")])
    x, y = side("x").where("c_x <> main"), side("y").drop("main").withColumnRenamed("key", "key_y")
    apart = (F.col("c_x") != F.col("c_y")) & ((F.col("c_y") == F.col("main")) | (F.col("x") < F.col("y")))
    tried = F.coalesce(F.col("hub_x") == F.col("y"), F.lit(False)) | F.coalesce(F.col("hub_y") == F.col("x"), F.lit(False))
    hopeless = (F.col("hub_x") == F.col("hub_y")) & ~may_reach(F.col("rel_x"), F.col("rel_y"), THRESHOLD)
    # Two lines may share several buckets; they meet in the first of them.
    first = F.array_position(F.zip_with("keys_x", "keys_y", lambda p, q: p == q), True) == F.shiftright(x["key"] + (1 << 31), 32) + 1
    rest = x.join(y, (x["key"] == y["key_y"]) & apart & ~tried & agree(F.col("bits_x"), F.col("bits_y")) & ~F.coalesce(hopeless, F.lit(False)) & first)
    rest = cut(rest.select("x", "y").distinct())
    more = compared(rest, docs, id_col, text_col, maps=False).where(enough(F.col("rel.both"), F.col("rel.n"), F.col("rel.n_hub"), THRESHOLD)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(tied.union(more))


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, gone): the numbers of the lines that a line elsewhere stands for."""
    places = cut(lines(docs, id_col, text_col).select("doc", "i", "a", "b"))
    first = F.min(F.struct("doc", "i")).alias("first")
    classes = cut(places.groupBy("a", "b").agg(first, F.count("*").alias("n")))
    release(docs.sparkSession)
    groups = cut(linked(docs, id_col, text_col))
    joined = classes.join(groups, classes["a"] == groups["node"], "left").where("n > 1 OR component IS NOT NULL")
    joined = cut(joined.select("a", "b", "first", "component"))
    # Written apart, so that the join below has no aggregation above it and its large components can be split.
    of_group = cut(joined.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least")))
    keeper = joined.join(of_group, "component", "left").select("a", "b", F.coalesce("least", "first").alias("keeper"))
    gone = places.join(keeper, ["a", "b"]).where(F.struct("doc", "i") != F.col("keeper"))
    return gone.groupBy("doc").agg(F.collect_set("i").alias("gone"))  # no more than the lines of one document


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that stays, and a struct `lines` (total, gone, chars, left); a column of that name is replaced."""
    gone = dropped(docs.select(id_col, text_col), id_col, text_col)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))  # the text moves once
    df = given.join(gone, given["id"] == gone["doc"], "left").withColumn("split", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    stays = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    df = df.withColumn("new", F.when(F.col("gone").isNotNull(), F.array_join(F.transform(stays, lambda k: F.get("split", k)), "\n")).otherwise(F.col("text")))
    told = F.struct(
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("total"),
        F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("gone"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.length("new"), F.lit(0)).cast("long").alias("left"),
    )
    return df.select(*[(F.col("new") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "lines"], told.alias("lines"))


def keep_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated lines, and without those documents that have no line left but blank ones."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("own")
    out = dedup_lines(docs.select(own, F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    out = out.where((F.col("lines.gone") == 0) | F.col("text").rlike(r"\S"))
    return out.select(*[(F.col("text") if c == text_col else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
