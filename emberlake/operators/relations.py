"""Lookups by range, pattern and suffix; graphs; retrieval; retention."""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import ip_number
from emberlake.operators.ordered import shared
from emberlake.sources.events import field

#: Bytes of a lookup list that may be broadcast, by rows times what a row may take; a longer list is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, row_bytes: int = 200) -> DataFrame:
    """df, marked for broadcast if its rows, of row_bytes at most, keep within the bound; it is counted up to the bound only."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tag(events: DataFrame, iocs: DataFrame, key: str) -> DataFrame:
    """events with the feed that lists their key, or null."""
    return events.join(bounded(iocs.groupBy(F.col("indicator").alias(key)).agg(F.min("feed").alias("ioc_feed"))), key, "left")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(lo, hi, label): ranges (cidr, label) with those that overlap or border on each other merged; the label of the first stays.

    Overlap runs through the whole list, so it is ordered as a whole; it is a lookup list of bounded length.
    """
    base, width = F.substring_index("cidr", "/", 1), F.when(F.col("cidr").contains("/"), F.substring_index("cidr", "/", -1).cast("int")).otherwise(32)
    r = ranges.select("label", ip_number(base).alias("lo"), F.pow(F.lit(2.0), 32 - width).cast("long").alias("n")).where("lo IS NOT NULL")
    r = r.select("label", (F.col("lo") - F.col("lo") % F.col("n")).alias("lo"), (F.col("lo") - F.col("lo") % F.col("n") + F.col("n") - 1).alias("hi"))
    order = Window.orderBy("lo", "label", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("label", F.struct("lo", "label", "hi")).alias("label")).drop("_run")


def by_range(rows: DataFrame, ip: Column, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """rows with the label of the merged range that holds their address."""
    return _in_range(rows, ip, merged_ranges(ranges), bits)


def by_disjoint(rows: DataFrame, ip: Column, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """rows with the label of the range that holds their address; ranges (networks of countries, say) don't overlap."""
    base, width = F.substring_index("cidr", "/", 1), F.substring_index("cidr", "/", -1).cast("int")
    r = ranges.select("label", ip_number(base).alias("lo"), F.pow(F.lit(2.0), 32 - width).cast("long").alias("n"))
    return _in_range(rows, ip, r.select("lo", (F.col("lo") + F.col("n") - 1).alias("hi"), "label"), bits)


def _in_range(rows: DataFrame, ip: Column, ranges: DataFrame, bits: int) -> DataFrame:
    """The join with ranges (lo, hi, label).

    Ranges are disjoint, so a row meets one at most. They are dealt to the blocks of 2 ** bits addresses that
    they meet, and each row joins by its block, and then between. A list within the bound is broadcast, and no row moves.
    """
    size = 1 << bits
    r = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("_block"))
    given = rows.withColumn("_n", ip_number(ip)).withColumn("_block", F.floor(F.col("_n") / size))
    hit = (given["_block"] == r["_block"]) & F.col("_n").between(F.col("lo"), F.col("hi"))
    return given.join(bounded(r), hit, "left").select(*[given[c] for c in rows.columns], "label")


def by_suffix(names: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """names with the longest listed domain that they are or lie under; two labels at least."""
    labels = F.split(F.lower(name), r"\.")
    each = names.select(name).distinct().select(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    hit = each.join(bounded(listed.select("domain").distinct()), "domain").groupBy(name).agg(F.max_by("domain", F.length("domain")).alias("listed"))
    return names.join(hit, name, "left")


def classify(objects: DataFrame, name: str, entries: DataFrame) -> DataFrame:
    """Each object with its catalog entries reduced: whether any is sensitive, the highest class, how many.

    Patterns are exact names, bare names that match the last part, and prefixes `a.b.*`; three kinds of key, one equi-join.
    """
    low = F.lower(name)
    parts = F.split(low, r"\.")
    # `a.b.*` matches `a.b` itself as well as what lies under it.
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "."), F.lit(".*")))
    each = objects.select(name).distinct().select(name, F.explode(F.array_distinct(F.concat(F.array(low, F.substring_index(low, ".", -1)), prefixes))).alias("pattern"))
    hit = each.join(bounded(entries.withColumn("pattern", F.lower("pattern"))), "pattern")
    return objects.join(hit.groupBy(name).agg(F.bool_or("sensitive").alias("sensitive"), F.max("rank").alias("rank"), F.count("*").alias("entries")), name, "left")


def edges(events: DataFrame) -> DataFrame:
    """Undirected labelled edges of the entity graph: host-ip, host-user, ip-user and user-person, each pair once."""
    ent = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    host, ip, user, person = ent("host", F.col("host")), ent("ip", field("src_ip")), ent("user", field("db_user")), ent("person", field("target_person"))
    lookup = F.col("service") == "postgres"
    pair = lambda a, b, label: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(label).alias("label"))
    all_ = F.array(pair(host, ip, "seen"), pair(host, user, "login"), pair(ip, user, "from"), F.when(lookup, pair(user, person, "looked_up")))
    return events.select(F.explode(F.array_compact(all_)).alias("e")).select("e.*").where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.max("label").alias("label"), F.count("*").alias("n"))


def entity_graph(events: DataFrame, cases: DataFrame) -> DataFrame:
    """(a, b, label) of the graph with cases (case_id, host, src_ip, user, db_user, target_person): a case's edges to its entities, and those of events.

    Events link host, address and user with each other, and lookups the acting user with the person. Where both kinds link a pair, the
    case's edge stands; blank names and links to oneself don't count.
    """
    name = lambda kind, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{kind}:"), F.trim(c)))
    case = name("case", F.col("case_id"))
    kinds = {"host": "host", "src_ip": "ip", "user": "user", "db_user": "staff", "target_person": "person"}
    of_cases = F.array(*[F.struct(case.alias("x"), name(kind, F.col(c)).alias("y"), F.lit(1).alias("rank")) for c, kind in kinds.items()])
    host, ip, user = name("host", F.col("host")), name("ip", field("src_ip")), name("user", field("user"))
    staff, person = name("staff", field("db_user")), name("person", field("target_person"))
    of_events = F.array(*[F.struct(x.alias("x"), y.alias("y"), F.lit(0).alias("rank")) for x, y in ((host, ip), (host, user), (ip, user), (staff, person))])
    all_ = cases.select(F.inline(of_cases)).unionByName(events.select(F.inline(of_events))).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    return strongest(all_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("rank") == 1, "case").otherwise("event").alias("label")))


def strongest(links: DataFrame) -> DataFrame:
    """Each pair (a, b) once, as `case` if any of its edges is one."""
    return links.groupBy("a", "b").agg(F.when(F.bool_or(F.col("label") == "case"), "case").otherwise("event").alias("label"))


#: Folders that nodes are dealt to, tasks that a node's neighbours are dealt to, and nodes that are looked up by name in the files' bloom filters.
NODE_BUCKETS, HUB_TASKS, LOOKED_UP = 32, 4, 1_000


def adjacency(links: DataFrame) -> DataFrame:
    """(a, b, label, bucket): each edge from both ends, written once; the events behind the edges aren't read again, whatever is asked.

    A node's neighbours are in the folder of its bucket, a hub's in several files.
    """
    columns = [c for c in ("label",) if c in links.columns]
    both = links.select("a", "b", *columns).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), *columns))
    both = both.withColumn("bucket", (F.crc32(F.col("a").cast("binary")) % NODE_BUCKETS).cast("int"))
    to = f"{_shared(links.sparkSession)}/adjacency-{uuid.uuid4().hex}"
    both.repartition("bucket", F.pmod(F.xxhash64("b"), F.lit(HUB_TASKS))).sortWithinPartitions("bucket", "a").write.partitionBy("bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#a", "true").parquet(to)
    return links.sparkSession.read.schema(both.schema).parquet(to)


def _shared(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def pivot(links: DataFrame, start: DataFrame, depth: int, goal: str | None = None, adjacent: DataFrame | None = None) -> DataFrame:
    """(node, hops, via) of the nodes within depth of the start nodes, by rounds of a frontier; the rounds end at the goal, or where nothing is new.

    A round reads the folders of its frontier's nodes, and of few nodes only the files' blocks that may hold them. Each round writes
    what it found; adjacent: edges as adjacency gives them, else they are written first.
    """
    spark = links.sparkSession
    adjacent = adjacency(links) if adjacent is None else adjacent
    folder, schema = f"{_shared(spark)}/pivot-{uuid.uuid4().hex}", "node string, hops int, via string"
    start.select(F.col("node").cast("string").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")).dropDuplicates(["node"]).write.parquet(f"{folder}/round=0")
    for k in range(1, depth + 1):
        front = spark.read.schema(schema).parquet(f"{folder}/round={k - 1}").where("node IS NOT NULL").select(F.col("node").alias("a"))
        names = [r["a"] for r in front.limit(LOOKED_UP + 1).collect()]
        if not names or goal is not None and not front.where(F.col("a") == goal).isEmpty():
            break
        if len(names) <= LOOKED_UP:
            edges_ = adjacent.where(F.col("bucket").isin(*sorted({crc32(n.encode()) % NODE_BUCKETS for n in names})) & F.col("a").isin(*names))
        else:
            edges_ = adjacent.join(bounded(front), "a", "left_semi")
        seen = spark.read.schema(schema).parquet(folder).select("node")
        new = edges_.where("b IS NOT NULL").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("via")).join(seen, "node", "left_anti")
        new.select("node", F.lit(k).alias("hops"), "via").write.parquet(f"{folder}/round={k}")
    return spark.read.schema(schema).parquet(folder).select("node", "hops", "via")


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a term. Lengths and frequencies are taken in one scan of the text."""
    tokens = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+")
    df = docs.select(F.col(id_col).alias("id"), F.filter(tokens, lambda t: t != "").alias("_w"))
    hits = F.filter("_w", lambda x: x.isin(terms))
    tf = lambda t: F.size(F.filter("_h", lambda x: x == F.lit(t)))
    df = df.select("id", F.size("_w").alias("len"), hits.alias("_h")).select("id", "len", *[tf(t).alias(f"tf_{k}") for k, t in enumerate(terms)])
    shared = docs.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared:  # the narrow table is read for the statistics and for the scores
        to = f"{shared.rstrip('/')}/bm25-{uuid.uuid4().hex}"
        df.write.parquet(to)
        df = docs.sparkSession.read.schema(df.schema).parquet(to)
    stats = df.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"df_{k}") for k in range(len(terms))])
    idf = lambda k: F.log(1 + (F.col("docs") - F.col(f"df_{k}") + 0.5) / (F.col(f"df_{k}") + 0.5))
    part = lambda k: idf(k) * F.col(f"tf_{k}") * (k1 + 1) / (F.col(f"tf_{k}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    score = part(0)
    for k in range(1, len(terms)):
        score = score + part(k)
    any_ = " OR ".join(f"tf_{k} > 0" for k in range(len(terms)))
    return df.where(any_).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # stats is one row


#: Vectors and probes that a cell of `nearest` compares at most, about, and those that it multiplies at once.
TASK_VECTORS, TASK_PROBES = 20_000, 10_000
BLOCK_VECTORS, BLOCK_PROBES = 4_000, 1_000
#: Products of matrices find what is nearest but for this much; what comes within it is computed as SQL does.
SLACK = 1e-9


def nearest(vectors: DataFrame, probes: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k most similar vectors of each probe by exact cosine; all pairs are compared.

    Slices of the vectors meet groups of the probes, each pair of them in a cell of its own, which multiplies blocks of them and gives its k
    best for a probe; so what a task holds doesn't grow with the tables. A cosine is the dot product over the root of the product of the
    squared lengths, summed in order, from -1 to 1; it is NaN, and first, where a length is 0, and null, and last, where a vector is
    null, empty, of another length or has a null.
    """
    kind = vectors.schema[vec_col].dataType
    v, p = (df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if kind.simpleString() == "array<float>" else "array<double>").alias("v")) for df in (vectors, probes))
    slices = max(-(-v.count() // TASK_VECTORS), v.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-p.count() // TASK_PROBES))
    # A vector goes to the cells of its slice, a probe to those of its group.
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    v = v.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: of(slices) * groups + g)))
    p = p.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: s * groups + of(groups))))
    id_type = vectors.schema[id_col].dataType.simpleString()
    met = p.groupBy("cell").cogroup(v.groupBy("cell")).applyInArrow(lambda x, y: _nearest_in(k, x, y), f"probe {id_type}, id {id_type}, cosine double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("cosine"), "id"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("probe", "place", "id", "cosine")


def _nearest_in(k: int, probes: pa.Table, vectors: pa.Table) -> pa.Table:
    """(probe, id, cosine) of one cell: at least the k best of each probe."""
    given, ids = (t["id"].to_numpy() for t in (probes, vectors))
    most = k + (int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 0)  # a probe isn't near to itself, how often its id may come
    out: list[tuple] = []
    of_probes, of_vectors = _matrices(probes["v"]), _matrices(vectors["v"])
    for n in {-1, *of_probes} if len(ids) else ():
        at, x = of_probes.get(n, (np.zeros(0, int), None))
        rows, y = of_vectors.get(n, (np.zeros(0, int), None))
        if n > 0 and len(at) and len(rows):
            same, held = _copies(y, ids[rows], most)
            for lo in range(0, len(at), BLOCK_PROBES):
                probe = at[lo : lo + BLOCK_PROBES]
                row, col, cosine = _best(x[lo : lo + BLOCK_PROBES], y[same], most)
                many = np.diff(held[1])[col]
                place = np.repeat(held[1][col] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                out.append((given[probe][np.repeat(row, many)], held[0][place], np.repeat(cosine, many), np.zeros(len(place), bool)))
        # Those without a cosine come last, so the first of them by id are enough.
        rest = np.sort(np.delete(ids, rows) if n > 0 else ids)[:most]
        if len(at) and len(rest) and (n < 0 or len(rows) < most):
            out.append((np.repeat(given[at], len(rest)), np.tile(rest, len(at)), np.zeros(len(at) * len(rest)), np.ones(len(at) * len(rest), bool)))
    probe, id_, cosine, null = (np.concatenate(c) for c in zip(*out)) if out else (given[:0], ids[:0], np.zeros(0), np.zeros(0, bool))
    other = probe != id_
    types = probes.schema.field("id").type
    return pa.table({"probe": pa.array(probe[other], types), "id": pa.array(id_[other], types), "cosine": pa.array(cosine[other], mask=null[other])})


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows and the matrix of the vectors of each length; -1 has the rows that have no cosine."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(int)
    flat, parent = column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    if flat.null_count:
        length[parent[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    length[length == 0] = -1
    values, found = flat.to_numpy(zero_copy_only=False).astype(float), {}
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        found[int(n)] = rows, values[length[parent] == n].reshape(-1, n) if n > 0 else None
    return found


def _copies(y: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A row of y for each of its distinct vectors, by their least id, and the first ids of each: (ids, bounds)."""
    order = np.argsort(ids, kind="stable")
    raw = np.ascontiguousarray(y[order]).view(np.dtype((np.void, y.shape[1] * 8))).ravel()
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))[of.ravel()]  # distinct vectors in the order of their least ids
    by = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[by], np.arange(len(first) + 1))
    kept = np.arange(len(by)) - bounds[place[by]] < most
    return order[np.sort(first)], (ids[order][by[kept]], np.concatenate([[0], np.cumsum(np.minimum(np.diff(bounds), most))]))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of vectors along the last axes of x and y, summed in order."""
    dot, xx, yy = 0.0, 0.0, 0.0
    for j in range(x.shape[-1]):
        a, b = x[..., j], y[..., j]
        dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
    return np.clip(dot / np.sqrt(xx * yy), -1.0, 1.0)


def _best(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, cosine) of the best pairs of each row of x, so many at most; of equal ones the first rows of y."""
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        usual_x, usual_y = ((n > 1e-100) & (n < 1e100) for n in (xx, yy))
        unit_x, unit_y = x / np.sqrt(xx)[:, None], y / np.sqrt(yy)[:, None]
        row, col, cosine = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        least = np.full(len(x), -np.inf)
        for lo in range(0, len(y), BLOCK_VECTORS):
            part = slice(lo, lo + BLOCK_VECTORS)
            near = unit_x @ unit_y[part].T
            for rows, cols in ((np.flatnonzero(~usual_x), np.arange(near.shape[1])), (np.arange(len(x)), np.flatnonzero(~usual_y[part]))):
                if len(rows) and len(cols):  # products of zero, endless or extreme vectors tell nothing
                    near[np.ix_(rows, cols)] = np.nan_to_num(_cosines(x[rows, None], y[None, lo + cols]), nan=2.0)
            floor = least
            if np.isneginf(least).any() and near.shape[1] > most:
                floor = np.maximum(least, np.partition(near, -most, axis=1)[:, -most])
            r, c = np.nonzero(near >= (floor - SLACK)[:, None])
            exact = [_cosines(x[r[i : i + 100_000]], y[lo + c[i : i + 100_000]]) for i in range(0, len(r), 100_000)]
            row, col, cosine = np.concatenate([row, r]), np.concatenate([col, lo + c]), np.concatenate([cosine, *exact])
            order = np.lexsort((col, -np.nan_to_num(cosine, nan=2.0), row))
            row, col, cosine = row[order], col[order], cosine[order]
            begins = np.searchsorted(row, np.arange(len(x)))
            kept = np.arange(len(row)) - begins[row] < most
            row, col, cosine = row[kept], col[kept], cosine[kept]
            full = np.bincount(row, minlength=len(x)) >= most
            last = np.searchsorted(row, np.arange(len(x)), "right") - 1
            least[full] = np.nan_to_num(cosine[last[full]], nan=2.0)
        return row, col, cosine


def fuse(signals: list[tuple[DataFrame, float]], key: str = "id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, place)."""
    parts = [df.select(key, (F.lit(w) / (k + F.col("place"))).alias("s")) for df, w in signals]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"), F.count("*").alias("signals"))


def hybrid(structured: DataFrame, fulltext: DataFrame, semantic: DataFrame, window: tuple[int, int], gated: bool, limit: int | None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 60, mark_over: int | None = None) -> DataFrame:
    """Ranked hits of three kinds fused: (id, host, service, message, us, score, signals) and `truncated`.

    With a limit these are the best hits, best first, and `truncated` tells whether there are more. Without one they are all hits, in no
    order, and `truncated` tells whether there are more than mark_over.

    structured and fulltext have (id, host, service, message, us, place), semantic (host, service, message, us, place), one
    row for each group of equal messages. Hits outside the window [from, to) don't count. With a gate, text hits count only
    if they are structured hits too. A semantic hit counts for every hit with its host, service and message; without such
    a hit it stands alone, unless there is a gate, or its own time is outside the window.
    """
    inside = lambda df: df.where((F.col("us") >= window[0]) & (F.col("us") < window[1]))
    own = ["id", "host", "service", "message", "us"]
    a, b = inside(structured), inside(fulltext)
    b = b.join(a.select("id"), "id", "left_semi") if gated else b
    rows = a.select(*own).unionByName(b.select(*own)).dropDuplicates(["id"])
    same = ["host", "service", "message"]
    met = rows.join(semantic.select(*same, "place"), same).select("id", "place")
    signals = [(a.select("id", "place"), weights[0]), (b.select("id", "place"), weights[1]), (met, weights[2])]
    if not gated:
        alone = inside(semantic).join(rows.select(*same).distinct(), same, "left_anti").withColumn("id", F.concat(F.lit("group:"), F.substring(F.sha2(F.concat_ws("\x00", *same), 256), 1, 16)))
        rows = rows.unionByName(alone.select(*own))
        signals.append((alone.select("id", "place"), weights[2]))
    scored = fuse(signals, "id", k).join(rows, "id")
    most = mark_over if limit is None else limit
    if most is None:
        return scored.withColumn("truncated", F.lit(False))
    scored = shared(scored, "hybrid")  # counted and then given
    more = scored.agg((F.count("*") > most).alias("truncated"))
    given = scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)
    return given.crossJoin(F.broadcast(more))  # one row


def shortest_path(links: DataFrame, start: str, end: str, depth: int = 6, adjacent: DataFrame | None = None) -> DataFrame:
    """(place, node) of a shortest path, the first by name of each step before; none if there isn't one within depth."""
    seen = pivot(links, links.sparkSession.createDataFrame([(start,)], "node string"), depth, end, adjacent)
    at, path = end, []
    while at is not None:  # a look-up for each step, depth at most
        row = seen.where(F.col("node") == at).select("hops", "via").first()
        if row is None:
            break
        path.append((row["hops"], at))
        at = row["via"]
    return links.sparkSession.createDataFrame(path, "place int, node string")


def attack_paths(links: DataFrame, cases: DataFrame, start: str, depth: int, adjacent: DataFrame | None = None) -> DataFrame:
    """Cases (case_id, node, level, disposition) within depth of the start, by level weight times disposition; none that count nothing."""
    from emberlake.operators.decisions import level_weight, multiplier

    seen = pivot(links, links.sparkSession.createDataFrame([(start,)], "node string"), depth, None, adjacent)
    score = level_weight(F.col("level")) * multiplier(F.col("disposition"))
    return cases.join(seen.select("node", "hops"), "node").withColumn("score", score).where("score > 0").select("case_id", "node", "hops", "score")


def top_nodes(links: DataFrame, nodes: int = 400, first: str = "host:") -> DataFrame:
    """(node, degree): hosts first, then by degree, then by name, so many at most."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return degree.orderBy((~F.col("node").startswith(first)).cast("int"), F.desc("degree"), "node").limit(nodes)


def pruned(events: DataFrame, ts_us: str, classes: list[tuple[str, int]], default_cutoff: int, held: list[str], tombstones: list[tuple[str, int, int]]) -> DataFrame:
    """events with what retention does to each: a class's own cutoff (a hold protects), the default, then erasure of a host in a range; null times stay."""
    source = F.col("source")
    own = None
    for name, cutoff in classes:
        own = F.when(source == name, F.lit(cutoff)) if own is None else own.when(source == name, F.lit(cutoff))
    cutoff = F.coalesce(own, F.lit(default_cutoff)) if own is not None else F.lit(default_cutoff)
    erased = F.lit(False)
    for host, lo, hi in tombstones:
        erased = erased | ((F.col("host") == host) & (F.col(ts_us) >= lo) & (F.col(ts_us) < hi))
    fate = F.when(F.col(ts_us).isNull(), "keep").when(source.isin(held), "keep").when(F.col(ts_us) < cutoff, "expire").when(erased, "erase").otherwise("keep")
    return events.withColumn("fate", fate)
