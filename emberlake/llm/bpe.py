"""Operator 9, byte-level BPE encoding and decoding: DuckDB recursive queries in each partition.

Spark deals out the documents; in a task, each text is split by the pattern, and the words not met before go
to a recursive query: rows of (place, token) join the table of merges on the ids of two neighbours, and each word
contracts its pairs of least rank, from the left, until no word has a pair left. A pair that a contraction makes has a
greater rank than the one contracted, so all pairs of the least rank are contracted in one step, and a long word takes
few. Decoding takes the ids alone: rows of (document, place, id) join the vocabulary, and an ordered aggregation
strings their bytes together. Words repeat, so a task keeps their ids in a table of bounded size; equal words always
get equal ids, whatever is kept.

Edge cases: null text is the empty text and has no ids; rows are encoded one by one, so repeated rows give
repeated results; texts and words of any length are encoded whole; an empty table gives an empty table; only the id,
the text and the columns named to be kept are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the pattern means it (Unicode's White_Space).
BLANK = r"\t-\r \x85\xa0  -     　"
#: Words kept in a task at most, words contracted by one query at most, rows of a batch.
KEPT, AT_ONCE, ROWS = 1_000_000, 200_000, 1000

#: A place is a word's number and, in its low 32 bits, a position. Pairs of the least rank may overlap (a token three
#: times in a row); of such a run every other one is contracted, the first included.
MERGE = """
WITH RECURSIVE t(place, tok, done) AS (
    SELECT place, tok, false FROM words
  UNION ALL (
    WITH pairs AS (SELECT place, tok, lead(place) OVER w AS after, lead(tok) OVER w AS next FROM t WHERE NOT done WINDOW w AS (ORDER BY place)),
    hits AS (SELECT place, after, merged FROM pairs JOIN merges ON pair = (tok::BIGINT << 20) | next WHERE after >> 32 = place >> 32),
    best AS (SELECT place >> 32 AS word, min(merged) AS least FROM hits GROUP BY 1),
    same AS (SELECT place, after, merged, lag(after) OVER (ORDER BY place) AS before FROM hits JOIN best ON place >> 32 = word AND merged = least),
    runs AS (SELECT *, sum(CASE WHEN before = place THEN 0 ELSE 1 END) OVER (ORDER BY place) AS run FROM same),
    taken AS (SELECT place, after, merged FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY place) % 2 = 1)
    SELECT p.place, coalesce(x.merged, p.tok)::INT, b.word IS NULL
    FROM pairs AS p LEFT JOIN taken AS x ON x.place = p.place LEFT JOIN best AS b ON b.word = p.place >> 32
    WHERE p.place NOT IN (SELECT after FROM taken))
)
SELECT place, tok FROM t WHERE done ORDER BY place
"""
DECODE = "SELECT doc, from_hex(string_agg(ranks.tok, '' ORDER BY place)) AS bytes FROM coded JOIN ranks ON ranks.rank = coded.tok GROUP BY doc"


def pattern_of(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"(?!\S)", f"(?![^{BLANK}])").replace(r"\s", f"[{BLANK}]"))


class Coder:
    """One for each Python worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import numpy as np
        import pyarrow as pa

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.find = pattern_of(pattern).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._fill("ranks", pa.table({"tok": [t.hex() for t in ranks], "rank": pa.array(ranks.values(), pa.int32())}))
        pairs = [((left << 20) | right, rank) for tok, rank in ranks.items() for k in range(1, len(tok)) if (left := ranks.get(tok[:k])) is not None and (right := ranks.get(tok[k:])) is not None]
        self._fill("merges", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "merged": pa.array([r for _, r in pairs], pa.int64())}))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.number: dict[str, int] = {}  # of each word kept
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # word k has ids[ends[k]:ends[k + 1]]

    def _fill(self, name: str, rows) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: set[str]) -> None:
        """Ids of words not met before."""
        import numpy as np
        import pyarrow as pa

        if len(self.number) > KEPT:
            self._forget()
        new = [w for w in words if w not in self.number]
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            coded = [w.encode() for w in part]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            place = (np.repeat(np.arange(len(coded)), sizes) << 32) | (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            self._fill("words", pa.table({"place": place, "tok": self.byte[np.frombuffer(b"".join(coded), np.uint8)]}))
            got = self.db.execute(MERGE).fetchnumpy()
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(got["place"] >> 32, minlength=len(part)))])
            self.ids = np.concatenate([self.ids, got["tok"].astype(np.int32)])

    def encode(self, texts: list[str]):
        """(ids of all texts in a row, where each text's end)."""
        import numpy as np

        split = [self.find(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        count = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        first, size = self.ends[word], self.ends[word + 1] - self.ends[word]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - until[:-1], size) + np.arange(until[-1])]
        return ids, until[np.concatenate([[0], np.cumsum(count)])]

    def decode(self, ids, ends) -> list[bytes]:
        """The bytes that each row's ids stand for."""
        import numpy as np
        import pyarrow as pa

        self._fill("coded", pa.table({"doc": np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends)), "place": np.arange(len(ids), dtype=np.int64), "tok": ids}))
        got = dict(self.db.execute(DECODE).fetchall())
        return [got.get(k, b"") for k in range(len(ends) - 1)]


@cache
def _coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: the id, the columns to keep, ids (array of int) and decoded (binary, made from the ids)."""

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, max(whole.num_rows, 1), ROWS):
                batch = whole.slice(start, ROWS)
                coder = _coder(path, pattern)
                ids, ends = coder.encode(batch.column(0).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, pa.array(coder.decode(ids, ends), pa.binary())], names=[*batch.schema.names[1:], "ids", "decoded"])

    # Names within the step are its own, as those of kept columns may have dots or clash.
    given = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate((id_col, *keep))])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:]), "ids array<int>", "decoded binary"])
    return given.mapInArrow(work, schema).toDF(id_col, *keep, "ids", "decoded")
