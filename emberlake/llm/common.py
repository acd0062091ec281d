"""What the corpus operators share: reading, words, the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='emberlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later stages don't recompute it, and a lost executor doesn't lose it."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark removes them when the driver's JVM collects what refers to them."""
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def nibbles_agreeing(a: Column, b: Column, longs: int, hashes: int) -> Column:
    """How many of the hashes minima agree in their low 4 bits, packed in longs: mismatches are folded to one bit each and counted."""
    total = F.lit(longs * 16)
    for k in range(longs):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(x)
    return total - (longs * 16 - hashes)


def bits_for(threshold: float, hashes: int, far_off: float) -> int:
    """The least number of agreeing nibbles for which a pair may reach the threshold: far_off standard deviations below its mean."""
    p = threshold + (1 - threshold) / 16  # agreement by chance is corrected for here, once
    return int(hashes * p - far_off * (hashes * p * (1 - p)) ** 0.5)


def enough(both: Column, x: Column, y: Column, threshold: float) -> Column:
    """Whether sets of x and y elements with both in common reach the Jaccard similarity."""
    percent = round(100 * threshold)
    return 100 * both >= percent * (x + y - both)


#: Bits of the maps that tell what a set has and lacks against its hub, in longs.
MAP_LONGS = 8


def against_hub(own: Column, hub: Column) -> Column:
    """How a set differs from that of its hub: sizes, common elements, bit maps of what it adds and lacks."""
    bit = lambda t: F.pmod(F.xxhash64(t), F.lit(64 * MAP_LONGS)).cast("int")

    def bitmap(x: Column) -> Column:
        place = lambda bits, k: F.aggregate(F.filter(bits, lambda b: F.shiftright(b, 6) == k), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))
        return F.element_at(F.transform(F.array(F.transform(x, bit)), lambda bits: F.array(*[place(bits, k) for k in range(MAP_LONGS)])), 1)

    return F.struct(F.size(own).alias("n"), F.size(hub).alias("n_hub"), F.size(F.array_intersect(own, hub)).alias("both"), bitmap(F.array_except(own, hub)).alias("adds"), bitmap(F.array_except(hub, own)).alias("lacks"))


def may_reach(x: Column, y: Column, threshold: float) -> Column:
    """False only for sets that can't reach the threshold; x and y tell how they differ from one hub (against_hub).

    Elements of the hub that either lacks aren't common, and neither are x's own additions whose bit y's additions
    don't set; the rest bounds the intersection from above.
    """
    count = lambda f: sum((F.bit_count(f(k)) for k in range(MAP_LONGS)), F.lit(0))
    lacked = F.greatest(count(lambda k: x["lacks"][k].bitwiseOR(y["lacks"][k])), x["n_hub"] - x["both"], y["n_hub"] - y["both"])
    alone = lambda p, q: p["n"] - p["both"] - count(lambda k: p["adds"][k].bitwiseAND(F.bitwise_not(q["adds"][k])))
    return enough(x["n_hub"] - lacked + F.least(alone(x, y), alone(y, x)), x["n"], y["n"], threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) can reach.

    Alternating large-star and small-star steps; each is a grouped minimum and an equi-join, so a hub
    with any number of neighbours is split by adaptive execution and no neighbour list is ever built.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs)
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
