"""Operator 12, document fingerprints: invertible Bloom lookup sketches of a text's paragraphs (native).

A paragraph is a line, or a sentence of a longer line; a text is the set of its paragraphs' 64-bit digests. Its fingerprint
is a sketch of TABLES times CELLS cells: each digest falls into one cell of each table, and a cell has the number of its
digests, their exclusive-or, and that of a second hash of them. Subtracting two sketches cell by cell leaves the digests that only
one text has. A cell with one of these tells it; taken out of its other cells it frees more of them (peeling), until the
sketch is empty and all that differs is recovered, or no such cell is left.

Then it is tried again with a larger sketch: in as many blocks as the two texts' digests need at LOAD a block, each with
its own cells; a digest's first bits name its block. A block that fails again gets twice the cells and other hashes, and so on. The
work is linear in the paragraphs, but for the dealing to blocks in two steps, which takes their number to the power 1.5
at a small factor, and all of it is in the row: no shuffle carries digests of blocks. If TRIES sizes fail, the sets are compared as they are.

Likeness is that of the sets: what both have over what any has, from the sizes and the recovered differences. Texts
without paragraphs are alike.

Versions: `edited` gives each text the first half of the next one for its last half. Which document follows which is found by a sort of
ids alone, in ranges, with a row a range for their borders. The parts of texts that move do so in one shuffle. Links are
broadcast up to LINKS of them, else joined by a shuffle.

Edge cases: null text counts as empty; a null id is one more id, the last; rows of one id and text are one document
(each is returned), rows of one id and other texts follow each other in the order of their hashes; the only document follows
itself; texts are read whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import cut

#: A line break, or white space after the end of a sentence.
BORDER = r"\n+|(?<=[.!?])\s+"
TABLES, CELLS = 3, 12
#: Digests of a block and cells of each of its tables at first; sizes that are tried; rounds of peeling.
LOAD, BLOCK_CELLS, TRIES, ROUNDS = 16, 10, 10, 16
#: Links are broadcast up to so many (about 100 bytes each).
LINKS = 500_000
CELL = "struct<n:int,id:bigint,check:bigint>"
STATE = f"struct<live:boolean,t0:array<{CELL}>,t1:array<{CELL}>,t2:array<{CELL}>,here:array<bigint>,there:array<bigint>>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BORDER, -1), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1))


def _placed(digest: Column, n: Column, cells: Column, seed: Column) -> Column:
    """A digest, n times, with its second hash and its cell in each table."""
    cell = lambda t: F.pmod(F.xxhash64(digest, F.lit(t), seed), cells).cast("int")
    return F.struct(n.alias("n"), digest.alias("id"), _check(digest).alias("check"), *[cell(t).alias(f"a{t}") for t in range(TABLES)])


def _with(cell: Column, placed: Column, sign: int) -> Column:
    n = cell["n"] + placed["n"] if sign > 0 else cell["n"] - placed["n"]
    return F.struct(n.alias("n"), cell["id"].bitwiseXOR(placed["id"]).alias("id"), cell["check"].bitwiseXOR(placed["check"]).alias("check"))


def sketch(of: Column, cells: Column, seed: Column) -> Column:
    """The tables of a set of digests, each an array of so many cells (n, id, check)."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("check"))
    table = lambda p, t: F.transform(F.sequence(F.lit(0), (cells - 1).cast("int")), lambda k: F.aggregate(F.filter(p, lambda d: d[f"a{t}"] == k), empty, lambda c, d: _with(c, d, 1)))
    return _let(F.transform(of, lambda d: _placed(d, F.lit(1), cells, seed)), lambda p: F.array(*[table(p, t) for t in range(TABLES)]))


def minus(a: Column, b: Column) -> Column:
    """One sketch less another of its size."""
    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, lambda x, y: _with(x, y, -1)))


def peeled(difference: Column, cells: Column, seed: Column) -> Column:
    """(here, there): the digests that a difference of sketches tells, or null if it doesn't tell all of them. A round without a telling cell is the last."""
    none = F.array().cast("array<bigint>")

    def round_(s: Column) -> Column:
        tells = lambda t: F.filter(s[f"t{t}"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["id"])))
        pure = F.array_distinct(F.concat(*[tells(t) for t in range(TABLES)]))

        def out(p: Column) -> Column:
            less = lambda t: F.transform(s[f"t{t}"], lambda c, k: F.aggregate(F.filter(p, lambda d: d[f"a{t}"] == k), c, lambda x, d: _with(x, d, -1)))
            side = lambda n: F.transform(F.filter(p, lambda d: d["n"] == n), lambda d: d["id"])
            return F.struct((F.size(p) > 0).alias("live"), *[less(t).alias(f"t{t}") for t in range(TABLES)], F.concat(s["here"], side(1)).alias("here"), F.concat(s["there"], side(-1)).alias("there"))

        return _let(F.transform(pure, lambda c: _placed(c["id"], c["n"], cells, seed)), out)

    def found(d: Column) -> Column:
        start = F.struct(F.lit(True).alias("live"), *[F.get(d, F.lit(t)).alias(f"t{t}") for t in range(TABLES)], none.alias("here"), none.alias("there"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["live"], round_(s)).otherwise(s))

    left = lambda s: F.exists(F.concat(*[s[f"t{t}"] for t in range(TABLES)]), lambda c: (c["n"] != 0) | (c["id"] != 0))
    return _let(_let(difference, found), lambda s: F.when(~left(s), F.struct(s["here"].alias("here"), s["there"].alias("there"))))


def _blocks(of: Column, bits: Column) -> Column:
    """The digests dealt to 2 ** bits blocks by their first bits, in two steps."""
    high = (bits / 2).cast("int")
    deal = lambda xs, many, skip: F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), many).cast("int") - 1), lambda k: F.filter(xs, lambda d: _bits(d, skip, many) == k))
    return F.flatten(F.transform(deal(of, high, F.lit(0)), lambda xs: deal(xs, bits - high, high)))


def _bits(digest: Column, skip: Column, many: Column) -> Column:
    """The value of many bits of a digest after the first skip bits."""
    up = F.call_function("shiftleft", digest, skip)
    return F.when(many == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", up, F.lit(64) - many).cast("int"))


def _larger(x: Column, y: Column) -> Column:
    """(here, there) of two small sets, by sketches that double until one tells all."""

    def attempt(found: Column, k: Column) -> Column:
        cells, seed = (F.lit(BLOCK_CELLS) * F.pow(F.lit(2), k)).cast("int"), k + 1
        return F.coalesce(found, peeled(minus(sketch(x, cells, seed), sketch(y, cells, seed)), cells, seed))

    none = F.lit(None).cast("struct<here:array<bigint>,there:array<bigint>>")
    plain = F.struct(F.array_except(x, y).alias("here"), F.array_except(y, x).alias("there"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), none, attempt), plain)


def difference(x: Column, y: Column, sketch_x: Column, sketch_y: Column) -> Column:
    """(here, there): the digests that only x has and those that only y has, from their fingerprints' cells, else from larger sketches."""
    small = peeled(minus(sketch_x, sketch_y), F.lit(CELLS), F.lit(0))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x) + F.size(y), F.lit(1)) / LOAD))).cast("int")
    each = _let(bits, lambda b: F.zip_with(_blocks(x, b), _blocks(y, b), _larger))
    large = _let(each, lambda e: F.struct(F.flatten(F.transform(e, lambda z: z["here"])).alias("here"), F.flatten(F.transform(e, lambda z: z["there"])).alias("there")))
    return F.coalesce(small, large)


def likeness(n_x: Column, n_y: Column, difference: Column) -> Column:
    apart = F.size(difference["here"]) + F.size(difference["there"])
    return F.when(n_x + n_y + apart == 0, F.lit(1.0)).otherwise((n_x + n_y - apart) / (n_x + n_y + apart))


def written(cells: Column) -> Column:
    """A fingerprint as hexadecimal text, 40 characters a cell."""
    return F.array_join(F.transform(F.flatten(cells), lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["id"]), 16, "0"), F.lpad(F.hex(c["check"]), 16, "0"))), "")


def follows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sum, prev, take): for each document the one it follows, by descending id, and the characters that this one takes from it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sum"), F.length(text).alias("n")).distinct()
    order = [F.desc_nulls_last("id"), F.asc("sum")]
    ranged = cut(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = F.struct("id", "sum", "n")
    within = Window.partitionBy("range").orderBy(*order)
    lasts = ranged.select("range", own.alias("own"), F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_first("id"), F.desc("sum"))).alias("k")).where("k = 1")
    whole = Window.orderBy("range")  # a row a range
    before = lasts.select("range", F.coalesce(F.lag("own").over(whole), F.last("own").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("border"))
    linked = ranged.withColumn("prev", F.lag(own).over(within)).join(F.broadcast(before), "range")
    prev = F.coalesce("prev", "border")
    return cut(linked.select("id", "sum", prev["id"].alias("prev_id"), prev["sum"].alias("prev_sum"), F.floor(prev["n"] / 2).cast("int").alias("take")))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (the text with its last half replaced by the beginning of the next document's), and own, new and next: the digests of the text, of the edited one and of the next document."""
    links = follows(docs, id_col, text_col)
    few = links.limit(LINKS + 1).count() <= LINKS
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("sum"), F.length(text).alias("n"), digests(text).alias("own"))
    links = links.withColumnsRenamed({"id": "id_", "sum": "sum_"})
    given = given.join(F.broadcast(links) if few else links, (F.col("sum") == F.col("sum_")) & F.col("id").eqNullSafe(F.col("id_")))
    keep, pass_on = (F.struct(a.alias("id"), b.alias("sum"), F.lit(own).alias("self"), F.left(F.col("text"), k).alias("head"), F.col("n"), F.col("own")) for a, b, own, k in ((F.col("id"), F.col("sum"), True, F.col("n") - F.floor(F.col("n") / 2).cast("int")), (F.col("prev_id"), F.col("prev_sum"), False, F.col("take"))))
    moved = given.select(F.inline(F.array(keep, pass_on))).repartition("id", "sum")
    mine, from_next = (lambda c: F.first(F.when(F.col("self"), F.col(c)), ignorenulls=True)), (lambda c: F.first(F.when(~F.col("self"), F.col(c)), ignorenulls=True))
    met = moved.groupBy("id", "sum").agg(F.count_if("self").alias("copies"), mine("n").alias("n"), F.concat(mine("head"), from_next("head")).alias("edited"), mine("own").alias("own"), from_next("own").alias("next"))
    return met.select("copies", F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited", "own", digests(F.col("edited")).alias("new"), "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, to_edited and to_next (the digests that differ, as here and there), near_edited and near_next."""
    cells, seed = F.lit(CELLS), F.lit(0)
    rows = edited(docs, id_col, text_col).withColumns({f"cells_{c}": sketch(F.col(c), cells, seed) for c in ("own", "new", "next")})
    told = rows.withColumns({"to_edited": difference(F.col("own"), F.col("new"), F.col("cells_own"), F.col("cells_new")), "to_next": difference(F.col("own"), F.col("next"), F.col("cells_own"), F.col("cells_next"))})
    near = lambda other, apart: likeness(F.size("own"), F.size(other), F.col(apart))
    out = told.select("copies", "doc_id", "n_chars", "edited", written(F.col("cells_own")).alias("fingerprint"), written(F.col("cells_new")).alias("edited_fingerprint"), "to_edited", "to_next", near("new", "to_edited").alias("near_edited"), near("next", "to_next").alias("near_next"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_copy")
