"""Operator 13, source divergence: how the terms of each source differ from its language's and from those of other sources.

A term is a run of ASCII letters and characters beyond ASCII; A-Z are lower-cased, nothing else. A language keeps the
terms that at least LEAST of its documents hold. A group (language, source) gives a kept term p = 1 + floor(SCALE *
(count + 1) / (N + V)), where N is its count of all kept terms and V their number; the language does so too. How far
p is from q is floor((p - q)^2 / q). Part `pair` sums that over all kept terms, for every other source of the
language; part `term` ranks the terms that a group has and holds likelier than its language does, up to TOP.

1. Tasks count terms and the documents that hold them by group, and hand on the counts whenever they hold ENTRIES
   of them; Spark sums them. A document has one group, so the documents of a language are the sum over its groups.
2. The kept terms are dealt by hash to chunks of about CHUNK terms, or fewer where a language has so many sources that
   the matrix of groups by terms would pass CELLS cells; a frequent term is a row of counts, whatever its frequency.
3. A chunk has its sorted array of terms; ids are places in it (searchsorted), counts by group are a bincount over ids. The
   ids keep the order of UTF-8 bytes, so vectors are dense and ties break by id. Each chunk sums the pairs over its
   terms and ranks its own best terms, TOP of a group at most, as no other can come in the first TOP.
4. Sums over chunks and the final ranks are small.

All numbers are integers: the quotient is taken in three steps of a factor of 1000, so counts may reach 9e15. The pairs
of sources are the result itself; no table has more rows than it, times the chunks.

Edge cases: null text, language and source are empty; a group without terms, or of a language that keeps none, has
pairs of value 0 and no terms; texts are read whole; repeated rows count as often as they come; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import cut

LEAST, SCALE_STEPS, STEP, TOP = 3, 3, 1000, 200
#: Entries of a task's counts, terms of a chunk, and cells of its matrix (8 bytes each, a few such matrices at once).
ENTRIES, CHUNK, CELLS = 200_000, 5_000, 2_000_000
#: Upper case becomes lower case, any other ASCII but letters a blank.
TERMS = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}

        def rows() -> Iterator:
            for (lang, source), (total, docs_) in held.items():
                terms = list(total)
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([docs_[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.translate(TERMS).split()
                total, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                total.update(words)
                docs_.update(set(words))
                if len(words) > ENTRIES or sum(len(t) for t, _ in held.values()) > ENTRIES:
                    yield from rows()
        yield from rows()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return _grouped(docs, lang_col, source_col, text.alias("text")).mapInArrow(work, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _grouped(docs: DataFrame, lang_col: str, source_col: str, *more) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), *more)


def _chunk(terms, groups):
    """The parts of one chunk; terms: rows (lang, chunk, term, source, n), groups: one row (lang, chunk, v, total, of)."""
    import numpy as np
    import pyarrow as pa

    side = groups.to_pylist()[0]
    lang, v = side["lang"], side["v"]
    sources = np.array(sorted(x["source"] for x in side["of"]), object)
    size = {x["source"]: x["n"] for x in side["of"]}
    known = np.array(sorted(set(terms.column("term").to_pylist())), object)
    ids = np.searchsorted(known, terms.column("term").to_numpy(zero_copy_only=False)).astype(np.int64)
    group = np.searchsorted(sources, terms.column("source").to_numpy(zero_copy_only=False)).astype(np.int64)
    n = terms.column("n").to_numpy().astype(np.int64)
    count = np.zeros((len(sources), len(known)), np.int64)
    for k in range(len(sources)):
        own = group == k
        count[k] = np.bincount(ids[own], minlength=len(known)) if len(known) else 0
        count[k, ids[own]] *= n[own]  # a group has a term once, so the bin holds its whole count

    def likely(c, total):
        """1 + floor(SCALE * (c + 1) / (total + v))."""
        out, rest = np.zeros_like(c), c + 1
        for _ in range(SCALE_STEPS):
            out, rest = out * STEP + rest * STEP // (total + v), rest * STEP % (total + v)
        return 1 + out

    p = np.stack([likely(count[k], size[s]) for k, s in enumerate(sources)])
    q = likely(count.sum(0), side["total"])
    columns: list[list] = [[], [], [], []]
    for k, source in enumerate(sources):
        far = ((p[k] - p) ** 2 // p).sum(1)
        for j, other in enumerate(sources):
            if j != k:
                for column, x in zip(columns, (source, "pair", other, int(far[j]))):
                    column.append(x)
        own = np.flatnonzero((count[k] > 0) & (p[k] > q))
        value = (p[k, own] - q[own]) ** 2 // q[own]
        for i in np.lexsort((own, -value))[:TOP]:
            for column, x in zip(columns, (source, "term", known[own[i]], int(value[i]))):
                column.append(x)
    kinds = [pa.string()] * 3 + [pa.int64()]
    return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value and rank."""
    by_term = counts(docs, text_col, lang_col, source_col).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = cut(by_term.where(F.col("docs") >= LEAST).drop("docs"))
    groups = cut(_grouped(docs, lang_col, source_col).distinct().join(kept.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("of")).join(vocabulary, "lang", "left").select("lang", "of", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    langs = cut(langs)
    chunks = langs.agg(F.max(F.ceil(F.col("v") / F.least(F.lit(chunk), F.greatest(F.lit(1), F.expr(f"{CELLS} div size(of)")))))).first()[0] or 1
    side = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "v", "total", "of")
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"), "term", F.inline("by"))
    parts = terms.groupBy("lang", "chunk").cogroup(side.groupBy("lang", "chunk")).applyInArrow(_chunk, "lang string, source string, part string, item string, value long")
    parts = cut(parts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    term = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pair.unionByName(term)
