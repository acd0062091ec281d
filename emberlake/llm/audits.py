"""Thin queries of operators 11 to 13, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import divergence, fingerprints, merkle
from emberlake.llm.common import table


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, checked against copies of which half have lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: F.sha2(merkle.encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text), 256)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    made = merkle.manifest(docs, leaf(F.col("text")), tampered)
    out = made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("carried", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: One step of CRC-32 (polynomial 0xEDB88320, reflected) for a byte, in eight shifts.
_BYTE = "xor(c, b)"
for _ in range(8):
    _BYTE = f"list_transform([{_BYTE}], lambda z: xor(z >> 1, 3988292384::BIGINT * (z & 1)))[1]"
OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {_BYTE}), 4294967295::BIGINT) AS crc
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
low AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, level, pos // 3, n),
parts AS (SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS pos, subroot AS h, count(*) OVER () AS n FROM parts
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (
  SELECT l.source, l.level, l.pos, l.h FROM low AS l WHERE n > 1
  UNION ALL
  SELECT p.source, p.height + h.level, h.pos, h.h FROM high AS h, parts AS p WHERE h.n > 1),
steps AS (
  SELECT d.doc_id, d.leaf, d.source, p.height, g.level, CASE WHEN g.level < p.height THEN d.pos // (3 ** g.level)::BIGINT ELSE p.place // (3 ** (g.level - p.height))::BIGINT END AS pos
  FROM placed AS d JOIN parts AS p ON d.source IS NOT DISTINCT FROM p.source, range(0, 64) AS g(level)
  WHERE g.level < p.height + (SELECT max(level) FROM high)),
runs AS (
  SELECT s.doc_id, s.leaf, s.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < s.pos), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > s.pos), '') AS after
  FROM steps AS s JOIN nodes AS n ON n.source IS NOT DISTINCT FROM s.source AND n.level = s.level AND n.pos // 3 = s.pos // 3 GROUP BY ALL),
proofs AS (SELECT doc_id, leaf, string_agg(before || after, '' ORDER BY level) AS proof FROM runs GROUP BY ALL),
fold AS (
  SELECT doc_id, leaf, 0 AS level, CASE WHEN crc % 2 = 0 THEN other ELSE leaf END AS h FROM docs
  UNION ALL
  SELECT f.doc_id, f.leaf, f.level + 1, sha256(r.before || f.h || r.after) FROM fold AS f JOIN runs AS r ON r.doc_id = f.doc_id AND r.leaf = f.leaf AND r.level = f.level),
ends AS (SELECT doc_id, leaf, arg_max(h, level) AS folded_root FROM fold GROUP BY ALL)
SELECT d.doc_id, d.leaf, p.subroot, t.h AS root, sha256(coalesce(x.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM docs AS d JOIN parts AS p ON d.source IS NOT DISTINCT FROM p.source JOIN ends AS e ON e.doc_id = d.doc_id AND e.leaf = d.leaf
LEFT JOIN proofs AS x ON x.doc_id = d.doc_id AND x.leaf = d.leaf, (SELECT h FROM high WHERE n = 1) AS t
"""



def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
seen AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS n FROM seen GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 1)) // (coalesce(t.n, 0) + z.v))::HUGEINT AS p
  FROM groups AS g JOIN kept AS k USING (lang) JOIN size AS z USING (lang) LEFT JOIN seen AS s USING (lang, source, term) LEFT JOIN total AS t ON t.lang = g.lang AND t.source = g.source),
whole AS (
  SELECT w.lang, w.term, (1 + (1000000000::HUGEINT * (w.n + 1)) // (t.n + z.v))::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM seen GROUP BY ALL) AS w JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY ALL) AS t USING (lang) JOIN size AS z USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM grid AS x JOIN grid AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT g.lang, g.source, 'term' AS part, g.term AS item, (((g.p - w.q) * (g.p - w.q)) // w.q)::BIGINT AS value FROM grid AS g JOIN whole AS w USING (lang, term) WHERE g.n > 0 AND g.p > w.q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= 200
"""

QUERIES = {f.__name__: f for f in (op11_merkle_manifest, op12_document_fingerprints, op13_source_divergence)}
ORACLES: dict[str, str] = {"op11_merkle_manifest": OP11_SQL, "op13_source_divergence": OP13_SQL}
