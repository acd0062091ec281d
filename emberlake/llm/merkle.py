"""Operator 11, a Merkle manifest of a dataset: a tree for each part, a tree over the parts, and a proof for each row.

Leaves are digests that Spark's own functions compute, so no text moves. They become a range-sorted RDD, by part and id. Each partition tells
how many leaves of its first and its last part it holds; from these counts, two a partition, follow the offset of the
part that goes on from an earlier partition and the totals of the parts that cross a boundary. All else is local:

1. A partition builds every subtree whose runs it holds whole (or up to the part's end). Nodes whose run reaches into
   another partition are ragged; there are a few at each level and boundary.
2. Ragged nodes are shuffled by their coordinate (part, band of BAND levels, ancestor), finished together, and go on
   to the next band: as many shuffles as the levels divided by BAND, each of a few rows a boundary.
3. Roots of parts go the same way once more, as the leaves of one tree.
4. Each partition asks for the nodes beside its paths that it doesn't hold, by coordinate, and gets them into its own
   partition: the answers are dealt as the leaves are, so the union with them moves no leaf.

A proof is an array with one string a level, from the leaf to the root of all: the digests of the run from left to
right, with "*" in the place of the node itself.

A task holds LEAVES leaves of about 100 bytes by design (rows that are equal in part and id stay together), the driver
a few numbers a partition and the sample that range bounds are made of. What is built is written to the shared folder,
so a lost executor costs its tasks alone.

Edge cases: a null part is a part of its own and the first; a null id comes first in its part; rows of equal part and
id are ordered by leaf, and equal rows are leaves of equal digest, side by side; null and empty fields differ ("-" and
"0:"); texts of any length are hashed whole; one part alone gives its own root; an empty table gives an empty manifest;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import cut

ARITY = 3
#: Leaves that a task holds, levels that one shuffle finishes, keys sampled for each partition's bound.
LEAVES, BAND, SAMPLED = 50_000, 5, 40
BUILT = "pid long, kind string, part string, n long, level int, pos long, digest string"


def encoded(*fields: Column) -> Column:
    """The fields as one string that tells them apart: "-" for null, else the length in UTF-8 bytes, ":" and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(f.cast("string")) for f in fields])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the path of its proof."""
    return F.aggregate(path, leaf, lambda h, run: F.sha2(F.replace(run, F.lit("*"), h), 256))


def siblings(path: Column) -> Column:
    """The siblings of a proof alone, left to right and level by level, in one string."""
    return F.replace(F.array_join(path, ""), F.lit("*"), F.lit(""))


def _digest(run: Iterable[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _key(part: str | None, id_: int | None) -> tuple:
    """Nulls first; Python orders strings by code points, as UTF-8 bytes do."""
    return part is not None, part or "", id_ is not None, id_ or 0


def _sizes(n: int) -> list[int]:
    """Nodes of each level over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def _known(start: int, leaves: list[str], sizes: list[int]) -> list[tuple[int, list[str]]]:
    """Per level, the first position and the digests that follow from these leaves alone."""
    known = [(start, leaves)]
    for n, above in zip(sizes, sizes[1:]):
        a, row = known[-1]
        first, last = -(-a // ARITY), above if a + len(row) == n else (a + len(row)) // ARITY
        known.append((first, [_digest(row[ARITY * p - a : ARITY * p - a + ARITY]) for p in range(first, last)]))
    return known


def _ragged(known: list, sizes: list[int]) -> Iterator[tuple[int, int, str]]:
    """(level, position, digest) of the nodes whose run isn't known whole; a root has no run."""
    for level in range(len(sizes) - 1):
        (a, row), (up, above) = known[level], known[level + 1]
        for p in [*range(a, min(a + len(row), ARITY * up)), *range(max(a, ARITY * (up + len(above))), a + len(row))] if above else range(a, a + len(row)):
            yield level, p, row[p - a]


def _wanted(start: int, end: int, known: list, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(level, position) of the nodes beside the paths of leaves start to end that aren't known."""
    lo, hi = start, end - 1
    for level, n in enumerate(sizes[:-1]):
        a, row = known[level]
        lo, hi = lo // ARITY, hi // ARITY
        b, first, last = a + len(row), ARITY * lo, min(ARITY * hi + ARITY, n)
        for p in [*range(first, min(a, last)), *range(max(b, first), last)] if row else range(first, last):
            yield level, p


def _spans(rows: list, plan: tuple[int, int, int]) -> Iterator[tuple]:
    """(part, rows, first position, total) of each part in a sorted partition; plan: offset and total of its first part, total of its last."""
    offset, n_first, n_last = plan
    groups = [(part, list(own)) for part, own in groupby(rows, key=itemgetter(0))]
    for k, (part, own) in enumerate(groups):
        yield part, own, offset if k == 0 else 0, n_first if k == 0 else n_last if k == len(groups) - 1 else len(own)


def _in_order(rows: Iterable) -> list:
    return sorted(rows, key=lambda r: (*_key(r[0], r[1]), r[2]))


def _ends(pid: int, rows: Iterator) -> Iterator[tuple]:
    """(pid, first part, its rows, last part, its rows) of a partition that has any."""
    counts: dict = {}
    for _, r in rows:
        counts[r[0]] = counts.get(r[0], 0) + 1
    if counts:
        first, last = (f(counts, key=lambda p: _key(p, 0)) for f in (min, max))
        yield pid, first, counts[first], last, counts[last]


def _plans(ends: list[tuple]) -> tuple[dict[int, tuple[int, int, int]], int]:
    """The plan of each partition, and the leaves of the largest part that crosses a boundary."""
    total: dict = {}
    for _, first, n, last, m in ends:
        total[first] = total.get(first, 0) + n
        if last != first:
            total[last] = total.get(last, 0) + m
    plans, before = {}, (object(), 0)
    for pid, first, n, last, m in sorted(ends):
        offset = before[1] if before[0] == first else 0
        plans[pid] = offset, total[first], total[last]
        before = (first, offset + n) if first == last else (last, m)
    return plans, max((total[f] for _, f, n, _, _ in ends if total[f] > n), default=0)


def _finished(band: int) -> Callable[[tuple], Iterator[tuple]]:
    """All nodes that follow from the ragged nodes below one ancestor, up to its level."""

    def work(grouped: tuple) -> Iterator[tuple]:
        (part, n, _), nodes = grouped
        sizes, rows = _sizes(n), {}
        for level, p, digest in nodes:
            rows.setdefault(level, {})[p] = digest
        for level in range(band * BAND, min((band + 1) * BAND, len(sizes) - 1)):
            here, up = rows.get(level, {}), rows.setdefault(level + 1, {})
            for p in {p // ARITY for p in here}:
                up[p] = _digest(here[q] for q in range(ARITY * p, min(ARITY * p + ARITY, sizes[level])))
                yield part, n, level + 1, p, up[p]

    return work


def _trees(df: DataFrame, n_rows: int, bounds: list[tuple], rows: RDD, above: Callable[[RDD], RDD]) -> RDD:
    """(part, id, leaf, carried, subroot, root, path) of rows (part, id, leaf, carried); above gives (part, (subroot, root, path)) from (part, subroot)."""
    spark = df.sparkSession
    tasks = len(bounds) + 1
    same = int  # one function for both shuffles, so that their union is a narrow one
    dealt = rows.map(lambda r: (bisect_right(bounds, _key(r[0], r[1])), r)).partitionBy(tasks, same)
    plans, longest = _plans(dealt.mapPartitionsWithIndex(_ends).collect())  # a row a partition
    tasks = dealt.getNumPartitions()

    def build(pid: int, given: Iterator) -> Iterator[tuple]:
        own = _in_order(r for _, r in given)
        for part, leaves, start, n in _spans(own, plans[pid]) if own else ():
            sizes = _sizes(n)
            known = _known(start, [r[2] for r in leaves], sizes)
            yield pid, "span", part, n, 0, 0, None
            for level, p, digest in _ragged(known, sizes):
                yield pid, "node", part, n, level, p, digest
            if known[-1][1]:
                yield pid, "root", part, n, 0, 0, known[-1][1][0]
            for level, p in _wanted(start, start + len(leaves), known, sizes):
                yield pid, "want", part, n, level, p, None

    built = cut(spark.createDataFrame(dealt.mapPartitionsWithIndex(build), BUILT, verifySchema=False))
    of = lambda kind: built.where(F.col("kind") == kind).drop("kind").rdd.map(tuple)
    ragged = of("node").map(lambda x: x[1:])
    nodes, roots, rising = ragged, of("root").map(lambda x: (x[1], x[5])), None
    for band in range(-(-(len(_sizes(longest)) - 1) // BAND)):
        top = (band + 1) * BAND
        entering = ragged.filter(lambda x, b=band: x[2] // BAND == b)
        entering = entering.union(rising) if rising else entering
        up = entering.map(lambda x, t=top: ((x[0], x[1], x[3] // ARITY ** (t - x[2])), x[2:])).groupByKey(tasks).flatMap(_finished(band))
        rising = up.filter(lambda x, t=top: x[2] == t)
        nodes = nodes.union(up)
        roots = roots.union(up.filter(lambda x: x[2] == len(_sizes(x[1])) - 1).map(lambda x: (x[0], x[4])))
    answers = of("want").map(lambda x: ((x[1], x[3], x[4]), x[0])).join(nodes.map(lambda x: ((x[0], x[2], x[3]), x[4])), tasks).map(lambda x: (x[1][0], (x[0], x[1][1])))
    tops = of("span").map(lambda x: (x[1], x[0])).join(above(roots), tasks).map(lambda x: (x[1][0], ((x[0], None, None), x[1][1])))
    got = answers.union(tops).map(lambda x: (x[0], (None, x[1]))).partitionBy(tasks, same)

    def prove(pid: int, given: Iterator) -> Iterator[tuple]:
        own, nodes = [], {}
        for _, x in given:
            if len(x) == 2:
                nodes[x[1][0]] = x[1][1]
            else:
                own.append(x)
        for part, leaves, start, n in _spans(_in_order(own), plans[pid]) if own else ():
            sizes = _sizes(n)
            known = _known(start, [r[2] for r in leaves], sizes)
            subroot, root, path = nodes[part, None, None]
            paths = {0: path}
            for level in range(len(sizes) - 2, -1, -1):
                scale, (a, row) = ARITY**level, known[level]
                at = lambda p: row[p - a] if a <= p < a + len(row) else nodes[part, level, p]  # noqa: B023, E731
                below = {}
                for up in range(start // scale // ARITY, (start + len(leaves) - 1) // scale // ARITY + 1):
                    run = range(ARITY * up, min(ARITY * up + ARITY, sizes[level]))
                    for p in run:
                        if start // scale <= p <= (start + len(leaves) - 1) // scale:
                            below[p] = ["".join("*" if q == p else at(q) for q in run), *paths[up]]
                paths = below
            for k, r in enumerate(leaves):
                yield *r, subroot, root, paths[start + k] if len(sizes) > 1 else path

    return dealt.union(got).mapPartitionsWithIndex(prove)


def manifest(docs: DataFrame, leaf: Column, carried: Column | None = None, id_col: str = "doc_id", part_col: str = "source", leaves: int = LEAVES) -> DataFrame:
    """id, part, leaf, carried, subroot, root and path (the proof) for each row; carried: any string that goes along."""
    spark = docs.sparkSession
    rows = docs.select(F.col(part_col).cast("string").alias("part"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), (F.lit(None) if carried is None else carried).cast("string").alias("carried"))
    n = docs.count()
    tasks = max(1, -(-n // leaves), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))
    sample = [_key(*r) for r in rows.select("part", "id").sample(fraction=min(1.0, SAMPLED * tasks / max(n, 1)), seed=7).collect()] if tasks > 1 else []

    def bounds(keys: list[tuple], tasks: int) -> list[tuple]:
        keys.sort()
        return sorted({keys[k * len(keys) // tasks] for k in range(1, tasks)}) if keys else []

    def over_parts(roots: RDD) -> RDD:
        roots = cut(spark.createDataFrame(roots, "part string, subroot string", verifySchema=False))
        m = roots.count()
        tasks = max(1, -(-m // leaves))
        keys = [_key(None, None)[:2] + (True, _key(r[0], 0)[:2]) for r in roots.select("part").sample(fraction=min(1.0, SAMPLED * tasks / max(m, 1)), seed=7).collect()] if tasks > 1 else []
        given = roots.rdd.map(lambda r: (None, _key(r[0], 0)[:2], r[1], r[0]))
        own = lambda top: top.map(lambda x: (x[0], (x[1], x[1], [])))
        return _trees(docs, m, bounds(keys, tasks), given, own).map(lambda x: (x[3], (x[2], x[5], x[6])))

    out = _trees(docs, n, bounds(sample, tasks), rows.rdd.map(tuple), over_parts)
    return spark.createDataFrame(out, "part string, id long, leaf string, carried string, subroot string, root string, path array<string>", verifySchema=False)
