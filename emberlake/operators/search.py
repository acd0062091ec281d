"""Written indexes: full text with labels and times, and vectors with approximate neighbours.

Both are tables of parts (sources.versions): a batch is one part and is appended without touching others; erasure and
expiry rewrite the parts that they concern; a search reads the live parts alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.operators.relations import bounded
from emberlake.sources import versions

#: Labels that a search can ask for.
LABELS = ("host", "service", "source", "severity", "log_type")
_LABELS = ", ".join(f"{c} string" for c in LABELS)
DOCS = f"id string, us long, {_LABELS}, message string"
POSTINGS = f"term string, block long, id string, tf int, len int, us long, {_LABELS}"
TERMS = "term string, block long, df long, most_tf int, least_len int"
#: Folders that terms are dealt to, and the span of time of one block of a term's postings.
BUCKETS, BLOCK_US = 64, 3_600_000_000
K1, B = 1.2, 0.75
#: Blocks that the first pass of a search scores.
FIRST_BLOCKS = 32


def words(text: str) -> list[str]:
    """The distinct terms of a query, by the same rule as those of messages."""
    return sorted({w for w in re.split("[^a-z0-9]+", text.lower()) if w})


def bucket_of(term: str) -> int:
    return crc32(term.encode()) % BUCKETS


def _put(df: DataFrame, folder: str, table: str, part: str, by: list[str], bucketed: bool) -> None:
    to = f"{folder}/{table}/part={part}"
    if bucketed:
        df = df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *by)  # the folder of a frequent term is dealt to tasks by its bytes
        df.write.partitionBy("bucket").option("compression", "zstd").parquet(to)
    else:
        df.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(to)


def index_text(events: DataFrame, folder: str, exclude: tuple[str, ...] = (), replaces: list[str] = (), block_us: int = BLOCK_US) -> str:
    """Appends events (id, us, the labels, message) as a part, without those of excluded sources; returns its name."""
    spark, part = events.sparkSession, versions.new_part()
    kept = events.where(~F.coalesce(F.col("source"), F.lit("")).isin(*exclude)) if exclude else events
    kept = kept.select(F.col("id").cast("string").alias("id"), "us", *LABELS, "message")
    _put(kept, folder, "docs", part, ["id"], False)
    docs = versions.read(spark, folder, "docs", [part], f"{DOCS}, part string").drop("part")
    # Documents are shuffled by id, and so not their terms, which are many times as large: those stay where their document is.
    split = docs.repartition("id").select("id", "us", *LABELS, _tokens().alias("_w")).withColumn("len", F.size("_w"))
    each = split.select("id", "us", *LABELS, "len", F.explode("_w").alias("term")).groupBy("term", "id", "us", *LABELS, "len").agg(F.count("*").cast("int").alias("tf"))
    each = each.withColumns({"block": F.coalesce(F.floor(F.col("us") / block_us), F.lit(-(1 << 62))), "bucket": (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int")})
    _finish(spark, folder, part, each, replaces, block_us)
    return part


def _tokens() -> Column:
    return F.filter(F.split(F.lower(F.coalesce("message", F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _finish(spark: SparkSession, folder: str, part: str, each: DataFrame, replaces: list[str], block_us: int) -> None:
    """Writes the postings of a part whose documents are written, and what is told of its terms, and commits it."""
    _put(each.select(*[c.split()[0] for c in POSTINGS.split(", ")], "bucket"), folder, "postings", part, ["term", "block"], True)
    written = versions.read(spark, folder, "postings", [part], f"{POSTINGS}, part string, bucket int")
    _put(written.groupBy("bucket", "term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("most_tf"), F.min("len").alias("least_len")), folder, "terms", part, ["term", "block"], True)
    docs = versions.read(spark, folder, "docs", [part], f"{DOCS}, part string")
    size = docs.select(F.size(_tokens()).alias("n")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    versions.commit(spark, folder, part, {"docs": size["docs"], "words": size["words"], "block_us": block_us}, replaces)


def rewrite_text(spark: SparkSession, folder: str, keep: Column) -> list[str]:
    """Takes the documents that aren't to be kept out of the index: the parts that hold any are written anew, then emptied. Returns them.

    keep is a condition on id, us and labels, which postings have as well; so these are filtered and not made again.
    """
    live = versions.live(spark, folder)
    docs = versions.read(spark, folder, "docs", [r["part"] for r in live], f"{DOCS}, part string")
    hit = [r["part"] for r in docs.where(~F.coalesce(keep, F.lit(False))).select("part").distinct().collect()]  # names of parts
    if not hit:
        return hit
    spans: dict[int, list[str]] = {}
    for r in live:
        if r["part"] in hit:
            spans.setdefault(int(r["facts"]["block_us"]), []).append(r["part"])
    for block_us, parts in spans.items():  # a span of time, a new part
        part = versions.new_part()
        _put(versions.read(spark, folder, "docs", parts, f"{DOCS}, part string").where(keep).drop("part"), folder, "docs", part, ["id"], False)
        _finish(spark, folder, part, versions.read(spark, folder, "postings", parts, f"{POSTINGS}, part string, bucket int").where(keep), parts, block_us)
    versions.swept(spark, folder, {"docs": DOCS, "postings": POSTINGS, "terms": TERMS})
    return hit


def prune_text(spark: SparkSession, folder: str, before_us: int) -> list[str]:
    """Documents older than the boundary of sealed time leave the index; those without time stay."""
    return rewrite_text(spark, folder, F.col("us").isNull() | (F.col("us") >= before_us))


def erase_host(spark: SparkSession, folder: str, host: str) -> list[str]:
    return rewrite_text(spark, folder, F.col("host").isNull() | (F.col("host") != host))


def _matching(df: DataFrame, labels: dict[str, list[str]], from_us: int | None, to_us: int | None, scope: list[str] | None) -> DataFrame:
    """Rows whose labels are among those asked for (one of each label's values, all labels), in [from, to), and of a source in scope."""
    for name, values in labels.items():
        if name not in LABELS:
            raise ValueError(f"{name} is no label")
        if values:
            df = df.where(F.col(name).isin(*values))
    if from_us is not None:
        df = df.where(F.col("us") >= from_us)
    if to_us is not None:
        df = df.where(F.col("us") < to_us)
    return df if scope is None else df.where(F.col("source").isin(*scope) if scope else F.lit(False))


def search_text(spark: SparkSession, folder: str, text: str, limit: int, labels: dict[str, list[str]] | None = None, from_us: int | None = None, to_us: int | None = None, scope: list[str] | None = None, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(place, id, score, us, the labels, message): the best documents that hold any of the terms.

    Frequencies are those of the whole index, whatever is asked for besides. A block of a term's postings has the most that
    it can add to a score; blocks of highest sums are scored first, and of the others only those that may still reach the worst of
    the best so far. Only the folders of the query's terms are read. A scope is a condition of its own; an empty one
    gives nothing.
    """
    parts, terms = versions.live(spark, folder), words(text)
    names = [r["part"] for r in parts]
    docs, total = (sum(int(r["facts"][k]) for r in parts) for k in ("docs", "words"))
    own = F.col("bucket").isin(*sorted({bucket_of(t) for t in terms})) & F.col("term").isin(*terms) if terms else F.lit(False)
    mean = total / docs if docs else 1.0
    told = versions.read(spark, folder, "terms", names, f"{TERMS}, part string, bucket int").where(own)
    idf = told.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = {r["term"]: r["idf"] for r in idf.collect()}  # a row a term of the query
    weight = F.lit(0.0)
    for t, w in idf.items():
        weight = F.when(F.col("term") == t, F.lit(w)).otherwise(weight)
    gain = lambda tf, length: weight * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / mean))
    spans = {int(r["facts"]["block_us"]) for r in parts}
    if len(spans) == 1:  # blocks wholly before or after the window hold nothing
        (span,) = spans
        told = told.where(F.col("block") >= from_us // span) if from_us is not None else told
        told = told.where(F.col("block") <= (to_us - 1) // span) if to_us is not None else told
    bound = told.groupBy("part", "block").agg(F.sum(gain("most_tf", "least_len")).alias("bound"))
    postings = _matching(versions.read(spark, folder, "postings", names, f"{POSTINGS}, part string, bucket int").where(own), labels or {}, from_us, to_us, scope)

    def best(of: DataFrame) -> list[tuple]:
        """(part, id, score) of the first rows, limit at most."""
        by_id = of.groupBy("part", "id").agg(F.round(F.sum(gain("tf", "len")), 9).alias("score"))
        return [tuple(r) for r in by_id.orderBy(F.desc("score"), "id").limit(limit).collect()]

    first = [tuple(r) for r in bound.orderBy(F.desc("bound"), "part", "block").limit(first_blocks).collect()]
    chosen = F.broadcast(spark.createDataFrame(first, "part string, block long, bound double").drop("bound"))
    top = best(postings.where(F.col("block").isin(*[b for _, b, _ in first])).join(chosen, ["part", "block"], "left_semi")) if first else []
    least = top[-1][2] if len(top) == limit else 0.0
    rest = bound.where(F.col("bound") >= least - 1e-8).join(chosen, ["part", "block"], "left_anti").select("part", "block")
    more = best(postings.join(bounded(rest), ["part", "block"], "left_semi")) if len(first) == first_blocks else []
    hits = spark.createDataFrame(sorted(top + more, key=lambda h: (-h[2], h[1]))[:limit], "part string, id string, score double")
    ids = [h["id"] for h in hits.collect()]
    stored = versions.read(spark, folder, "docs", names, f"{DOCS}, part string").where(F.col("id").isin(*ids) if ids else F.lit(False))  # the files' bloom filters look these up
    order = Window.orderBy(F.desc("score"), "id")  # limit rows
    return stored.join(F.broadcast(hits), ["part", "id"]).select(F.row_number().over(order).alias("place"), "id", "score", "us", *LABELS, "message")


#: Vectors that centres are fitted on, at most; rows of one list that a task compares at once; the most lists.
SAMPLE, SLICE, LISTS = 20_000, 50_000, 4_096
VECTORS = "id long, scale float, code binary, vec array<float>"
CENTRES = "list int, centre array<double>"


def _unit(column):
    """The vectors of an Arrow column as a matrix of rows of length one (a null or zero vector stays zero), in float64."""
    import numpy as np

    rows = column.to_pylist()
    dim = max((len(r) for r in rows if r), default=1)
    m = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        if r and len(r) == dim:
            m[k] = r
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _centres(spark: SparkSession, folder: str):
    import numpy as np

    return np.array([r["centre"] for r in spark.read.schema(CENTRES).parquet(f"{folder}/centres").orderBy("list").collect()])  # LISTS rows at most


def fit_centres(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> int:
    """Centres of the lists, by k-means over the SAMPLE vectors of least hash; about the root of the number of vectors, unless told. Returns how many."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    lists = lists or max(1, min(LISTS, round(n**0.5)))
    some = vectors.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    norm = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = some.select(F.col(vec_col).alias("v"), F.nullif(norm, F.lit(0.0)).alias("n")).where("n IS NOT NULL").select(array_to_vector(F.transform("v", lambda x: x / F.col("n"))).alias("features"))
    found = KMeans(k=lists, seed=11, maxIter=10).fit(unit).clusterCenters()
    centres = [[float(x) for x in c / ((c @ c) ** 0.5 or 1.0)] for c in found]
    vectors.sparkSession.createDataFrame(list(enumerate(centres)), CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return len(centres)


def index_vectors(vectors: DataFrame, folder: str, id_col: str = "vec_id", vec_col: str = "embedding") -> str:
    """Appends all vectors of the centres' length as a part: each in the list of its nearest centre, with a code of a byte a dimension beside it; returns its name."""
    spark, part, centres = vectors.sparkSession, versions.new_part(), _centres(vectors.sparkSession, folder)

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            m = _unit(batch.column("vec"))
            near = (m @ centres.T).argmax(1)
            scale = np.abs(m).max(1)
            codes = np.rint(m / np.where(scale == 0, 1, scale)[:, None] * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scale / 127, pa.float32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vec"), pa.array(near, pa.int32())], names=["id", "scale", "code", "vec", "list"])

    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.size("vec") == centres.shape[1])
    dealt = given.mapInArrow(work, f"{VECTORS}, list int").repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.partitionBy("list").option("compression", "zstd").parquet(f"{folder}/vectors/part={part}")
    versions.commit(spark, folder, part, {})
    return part


def search_vectors(probes: DataFrame, folder: str, n: int, lists: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(probe, place, id, cosine): about the n nearest vectors of each probe, itself left out, by exact cosine.

    A probe looks into the lists of its nearest centres. There the codes give max(4 n, n + 16) candidates, whose vectors are then read
    and compared exactly. Folders of other lists aren't read. A long list is compared in slices of SLICE rows.
    """
    spark, centres, fetch = probes.sparkSession, _centres(probes.sparkSession, folder), max(4 * n, n + 16)

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            m = _unit(batch.column("vec"))
            k = min(lists, len(centres))
            order = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(m)), order.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("vec").take(pa.array(at)), pa.array(order.reshape(-1), pa.int32())], names=["probe", "vec", "list"])

    asked = probes.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.size("vec") == centres.shape[1]).mapInArrow(near, "probe long, vec array<float>, list int")
    wanted = sorted(r["list"] for r in asked.select("list").distinct().collect())  # LISTS at most
    parts = [r["part"] for r in versions.live(spark, folder)]
    held = versions.read(spark, folder, "vectors", parts, f"{VECTORS}, part string, list int").where(F.col("list").isin(*wanted) if wanted else F.lit(False))
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    codes = held.select("id", "scale", "code", "list").join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "scale", "code")
    sides = asked.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "probe", "vec")

    def match(rows, looking):
        import numpy as np
        import pyarrow as pa

        probe, got = looking.column("probe").to_numpy(), []
        if rows.num_rows and len(probe):
            code = np.stack([np.frombuffer(c, np.int8) for c in rows.column("code").to_pylist()]).astype(np.float32) * rows.column("scale").to_numpy()[:, None]
            ids = rows.column("id").to_numpy()
            for a in range(0, len(probe), 64):
                close = _unit(looking.column("vec").slice(a, 64)).astype(np.float32) @ code.T
                close[probe[a : a + 64, None] == ids[None, :]] = -2
                best = np.argpartition(-close, fetch - 1, axis=1)[:, :fetch] if fetch < close.shape[1] else np.tile(np.arange(close.shape[1]), (len(close), 1))
                got += [(np.full(best.shape[1], probe[a + k]), ids[b], close[k, b]) for k, b in enumerate(best)]
        cols = [np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in range(3)]
        name = looking.column("list")[0].as_py() if looking.num_rows else 0
        keep = cols[2] > -2
        return pa.table({"probe": pa.array(cols[0][keep], pa.int64()), "id": pa.array(cols[1][keep], pa.int64()), "list": pa.array([name] * int(keep.sum()), pa.int32()), "near": pa.array(cols[2][keep], pa.float64())})

    close = codes.groupBy("list", "slice").cogroup(sides.groupBy("list", "slice")).applyInArrow(match, "probe long, id long, list int, near double")
    band = close.withColumn("k", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("near"), "id"))).where(F.col("k") <= fetch).select("probe", "id", "list")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    full = held.select("id", "list", "vec").join(bounded(band, 24), ["id", "list"]).join(probes.select(F.col(id_col).cast("long").alias("probe"), F.col(vec_col).alias("p")), "probe")
    size = F.nullif(F.sqrt(dot(F.col("vec"), F.col("vec")) * dot(F.col("p"), F.col("p"))), F.lit(0.0))
    cosine = F.coalesce(dot(F.col("vec"), F.col("p")) / size, F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("cosine"), "id"))
    return full.select("probe", "id", cosine.alias("cosine")).withColumn("place", place).where(F.col("place") <= n).select("probe", "place", "id", "cosine")
