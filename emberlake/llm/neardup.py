"""Operator 4, near-duplicates by b-bit MinHash.

1. Each text's distinct word shingles give HASHES minima. Rows of ROWS minima are hashed to band keys; of every
   minimum the low BITS bits stay, packed in longs.
2. Texts with equal shingle sets form a class, whose smallest id stands for it.
3. Tree links: in each bucket (band key) every class is compared with the bucket's most central class (its hub)
   alone. The similarity estimated from the packed bits, corrected for chance agreement, leaves the hubs that may be
   near, and of those a class takes the one that meets most others, so a group of copies shares one hub; the link is confirmed on full sets, and what the class adds to its hub and lacks of it is kept as bit maps.
4. The rest, exactly: in buckets with classes of several components, the members outside the bucket's main
   component meet those of other components, but for pairs that can't be links: those whose corrected estimate is
   FAR_OFF standard deviations below the threshold, and those of one hub whose differences from it rule a link out
   (common.may_reach, which loses none). For members of such buckets the estimate is taken once more, from FINE minima,
   so that unlinked texts of one template, which are alike but not enough, are ruled out too, whatever their length. What is left is
   confirmed on full sets. No pair inside one component is formed, so a group costs about its size and not its square in
   rows; within a hot bucket the members outside the main component still meet in the join's condition.
5. Components of all links give the groups; the smallest id of each stays.

A pair at the threshold shares no bucket with probability (1 - t ** ROWS) ** BANDS, 1.2e-7 at 0.8, and the
estimate fails it with less than 1e-6.

Edge cases: null and empty texts, or texts without words, have the empty set and are linked with nothing; rows
without id have no component and are kept; rows that share an id count as one document that has the links of
all of them; texts are read whole; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import against_hub, bits_for, components, cut, enough, may_reach, nibbles_agreeing, release

WIDTH, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
BITS = 4
LONGS = -(-HASHES * BITS // 64)
FAR_OFF = 5.0
#: Minima of the finer estimate, whose standard deviation at the threshold is 0.0125 before correction.
FINE = 1_024
#: Ids to be looked up in the texts are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 500_000


def agree(a: Column, b: Column, threshold: float) -> Column:
    """False only (but for FAR_OFF standard deviations) for texts that don't reach the threshold."""
    return nibbles_agreeing(a, b, LONGS, HASHES) >= bits_for(threshold, HASHES, FAR_OFF)


def estimate(a: Column, b: Column) -> Column:
    """Similarity corrected for minima that agree in their low bits by chance."""
    chance = 2.0**-BITS
    return (nibbles_agreeing(a, b, LONGS, HASHES) / HASHES - chance) / (1 - chance)


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), h1 and h2 (a hash of the whole set), bands and bits per row."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from emberlake.llm.shingles import U, chunks, mix, shingle_hashes

        rng = np.random.default_rng(20240202)
        odd = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        flip = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
        salt = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
        for whole in batches:
            for a, b in chunks(whole.column("text")):
                batch = whole.slice(a, b - a)
                hashes, ends = shingle_hashes(batch.column("text"), width)
                n = np.diff(ends)
                full = np.flatnonzero(n)
                minima = np.zeros((HASHES, len(n)), np.uint32)
                if len(full):
                    short, at = (hashes >> U(32)).astype(np.uint32), ends[:-1][full]
                    x = np.empty_like(short)
                    for k in range(HASHES):
                        np.bitwise_xor(short, flip[k], out=x)
                        np.multiply(x, odd[k], out=x)
                        minima[k, full] = np.minimum.reduceat(x, at)
                wide = minima.astype(np.uint64)
                keys = mix((wide * salt[:, None]).reshape(BANDS, ROWS, -1).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * salt[0])
                low = np.zeros((LONGS * (64 // BITS), len(n)), np.uint64)
                low[:HASHES] = wide & U((1 << BITS) - 1)
                packed = (low.reshape(LONGS, 64 // BITS, -1) << (np.arange(64 // BITS, dtype=np.uint64) * U(BITS))[None, :, None]).sum(1, dtype=np.uint64)
                sums = lambda v: (np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=np.uint64)])[ends[1:]] - np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=np.uint64)])[ends[:-1]]).view(np.int64)
                rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[0], dtype=np.int32)), pa.array(np.ascontiguousarray(m.T).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), pa.array(sums(mix(hashes))), pa.array(sums(mix(hashes ^ U(0x5851F42D4C957F2D)))), rows(keys), rows(packed)], names=["id", "n", "h1", "h2", "bands", "bits"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(work, "id long, n long, h1 long, h2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shingles) of the rows of docs whose id is in ids."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from emberlake.llm.shingles import chunks, shingle_hashes

        for whole in batches:
            for a, b in chunks(whole.column("text")):
                batch = whole.slice(a, b - a)
                hashes, ends = shingle_hashes(batch.column("text"), width)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "shingles"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(work, "id long, shingles array<long>")


def fine_bits(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fine): low bits of FINE minima, packed in longs, of the rows of docs whose id is in ids."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from emberlake.llm.shingles import U, chunks, mix, shingle_hashes

        salts = mix(np.arange(1, FINE + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
        per = 64 // BITS
        shifts = np.arange(per, dtype=np.uint64) * U(BITS)
        for whole in batches:
            for a, b in chunks(whole.column("text")):
                batch = whole.slice(a, b - a)
                hashes, ends = shingle_hashes(batch.column("text"), width)
                full = np.flatnonzero(np.diff(ends))
                low, x = np.zeros((FINE, len(ends) - 1), np.uint64), np.empty_like(hashes)
                for k in range(FINE if len(full) else 0):
                    np.multiply(hashes, salts[k], out=x)
                    low[k, full] = (np.minimum.reduceat(x, ends[:-1][full]) >> U(20)) & U((1 << BITS) - 1)
                packed = (low.reshape(FINE // per, per, -1) << shifts[None, :, None]).sum(1, dtype=np.uint64)
                ends = pa.array(np.arange(0, packed.size + 1, FINE // per, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(packed.T).reshape(-1).view(np.int64)))], names=["id", "fine"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(work, "id long, fine array<long>").dropDuplicates(["id"])


def compared(docs: DataFrame, pairs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """pairs (a, b) with `rel`, how the full set of b differs from that of a; pairs is a written table."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = cut(full_sets(docs, ids, width, id_col, text_col))
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    return pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", against_hub(F.col("set_b"), F.col("set_a")).alias("rel"))


def central(bucket: DataFrame) -> DataFrame:
    """(key, hub, met): of each bucket (key, id, m members) the member that meets most others over all buckets, and how many.

    Copies of one text are nearer to it than to each other, so that text, if it is there, meets most and all of
    its copies are compared with it; the smallest id breaks ties.
    """
    meets = bucket.groupBy("id").agg(F.sum("m").alias("met"))
    best = bucket.join(meets, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("id"))).alias("h"))
    return best.select("key", (-F.col("h.id")).alias("hub"), F.col("h.met").alias("met"))


def links(docs: DataFrame, signed: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) whose components are those of all links; signed is a written table."""
    percent = round(100 * threshold)
    some = signed.where("n > 0 AND id IS NOT NULL")
    # Written apart, so that the join below has no aggregation above or beside it and its large classes can be split.
    classes = cut(some.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"))
    member = some.select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"]).where("id <> rep")
    member = cut(member.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    reps = some.join(member.select(F.col("a").alias("id")), "id", "left_anti").select("id", "n", "bands", "bits").dropDuplicates(["id", "n"])
    reps = cut(reps)
    keys = reps.select("id", F.explode("bands").alias("key")).repartition("key")
    # The count names id, so that both readers of the exchange want the same columns and it is reused.
    shared = keys.groupBy("key").agg(F.count("id").alias("m")).where("m > 1")
    bucket = cut(keys.join(shared.hint("shuffle_hash"), "key").select("key", "id", "m"))
    sig = reps.select("id", "n", "bits")
    of = lambda c: sig.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    fits = (percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & agree(F.col("bits_a"), F.col("bits_b"), threshold)
    reach = enough(F.col("rel.both"), F.col("rel.n"), F.col("rel.n_hub"), threshold)

    to_hub = bucket.join(central(bucket), "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "met").distinct()
    near = to_hub.join(of("b"), "b").join(of("a"), "a").where(fits).select("a", "b", "met", estimate(F.col("bits_a"), F.col("bits_b")).alias("j"))
    # The most central of the hubs that may be near, so that a group of copies has one hub in common.
    tree = cut(near.groupBy("b").agg(F.max_by("a", F.struct("met", "j", -F.col("a"))).alias("a")).select("a", "b"))
    release(docs.sparkSession)
    told = cut(compared(docs, tree, width, id_col, text_col))
    release(docs.sparkSession)
    tied = told.where(reach).select("a", "b")

    groups = cut(components(tied))
    release(docs.sparkSession)
    placed = cut(bucket.join(groups, bucket["id"] == groups["node"], "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    mixed = placed.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("several")).where("several > 1").select("key", "main")
    known = sig.join(told.select(F.col("b").alias("id"), F.col("a").alias("hub"), "rel"), "id", "left")
    mixed = cut(placed.join(mixed, "key"))
    fine = fine_bits(docs, cut(mixed.select("id").distinct()), width, id_col, text_col)
    open_ = cut(mixed.join(known.join(fine, "id"), "id"))
    release(docs.sparkSession)
    side = lambda z: open_.select("key", "main", F.col("id").alias(z), *[F.col(k).alias(f"{k}_{z}") for k in ("c", "n", "bits", "hub", "rel", "fine")])
    apart = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b")))
    tried = F.coalesce(F.col("hub_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("hub_b") == F.col("a"), F.lit(False))
    finely = nibbles_agreeing(F.col("fine_a"), F.col("fine_b"), FINE * BITS // 64, FINE) >= bits_for(threshold, FINE, FAR_OFF)
    hopeless = F.coalesce((F.col("hub_a") == F.col("hub_b")) & ~may_reach(F.col("rel_a"), F.col("rel_b"), threshold), F.lit(False))
    x, y = side("a").where("c_a <> main"), side("b").drop("main").withColumnRenamed("key", "key_b")
    rest = cut(x.join(y, (x["key"] == y["key_b"]) & apart & ~tried & fits & ~hopeless & finely).select("a", "b").distinct())
    more = compared(docs, rest, width, id_col, text_col).where(reach).select("a", "b")
    return member.union(tied).union(more)


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of docs."""
    signed = cut(signatures(docs, width, id_col, text_col))
    groups = components(links(docs, signed, width, threshold, id_col, text_col))
    out = signed.select("id", "n").join(groups, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that another one of their group stands for."""
    out = near_duplicates(docs.select(id_col, text_col), width, threshold, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    out = cut(out)
    few = out.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(out) if few else out, docs[id_col] == out["_gone"], "left_anti")
