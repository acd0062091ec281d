"""Thin queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, decontaminate, html, linededup, neardup, pii, quality, secrets, urls, warc
from emberlake.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.total").alias("n_lines"), F.col("lines.gone").alias("n_gone"), F.col("lines.left").alias("n_chars_left"), "text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_tokens")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Minutes that fetch times and the list span: 30 days.
SPAN = 43_200
#: Dated entries of the list that names hosts outright: (pattern, category, minute, action).
NAMED = [
    ("cheap-pills.example.com", "spam", 0, "add"),
    ("spam-farm.example.org", "spam", 1_440, "add"),
    ("spam-farm.example.org", "spam", 20_160, "remove"),
    ("spam-farm.example.org", "spam", 30_000, "add"),
    ("example.net", "parked", 30_000, "add"),
    ("example.net", "parked", 31_000, "remove"),
]
#: The list's other entries are made by rule from a number n (the first 16 bits of a host's MD5):
#: (condition, what follows the host in the pattern, category, minute, action).
DATED = [
    ("n % 4 = 0", "", "spam", "n % 43200", "add"),
    ("n % 8 = 0", "", "spam", "n % 43200 + 7200", "remove"),
    ("n % 16 = 0", "", "spam", "n % 43200 + 14400", "add"),
    ("n % 5 = 0", "", "malware", "(n * 3) % 43200", "add"),
    ("n % 7 = 0", "/en", "adult", "(n * 7) % 43200", "add"),
    ("n % 3 = 0", "/en", "allow", "(n * 11) % 43200", "add"),
]


def fetched(pages: DataFrame) -> DataFrame:
    """pages has no fetch time; one is set by rule from the id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 7919, F.lit(SPAN)).alias("fetched"))


def dated_list(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(pattern, category, at, action): the named entries and those by rule for the hosts of pages."""
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("long"))
    made = F.array(*[F.when(F.expr(when), F.struct(F.concat("host", F.lit(tail)).alias("pattern"), F.lit(category).alias("category"), F.expr(at).alias("at"), F.lit(action).alias("action"))) for when, tail, category, at, action in DATED])
    by_rule = hosts.select(F.explode(F.array_compact(made)).alias("x")).select("x.*")
    named = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("category"), F.lit(at).cast("long").alias("at"), F.lit(a).alias("action")) for p, c, at, a in NAMED])
    return by_rule.union(spark.range(1).select(F.inline(named)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(fetched(pages), dated_list(spark, pages))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scans, op2_html_extraction, op3_quality_rules, op4_minhash_near_dedup, op5_warc, op6_line_dedup, op7_pii, op8_decontamination, op9_byte_bpe, op10_url_filters)
}

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS keeper FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM k
"""

_NAMED_SQL = ", ".join(f"('{p}', '{c}', {at}::BIGINT, '{a}')" for p, c, at, a in NAMED)
_DATED_SQL = " UNION ALL ".join(f"SELECT host || '{tail}' AS pattern, '{c}' AS category, {at} AS minute, '{a}' AS action FROM hosts WHERE {when}" for when, tail, c, at, a in DATED)
OP10_SQL = f"""
WITH seen AS (
  SELECT page_id, url, (page_id * 7919) % {SPAN} AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::BIGINT AS n FROM (SELECT DISTINCT host FROM seen WHERE host <> '')),
entries AS (SELECT pattern, category, minute, max(action) AS action FROM ({_DATED_SQL} UNION ALL SELECT pattern, category, minute, action FROM (VALUES {_NAMED_SQL}) AS v(pattern, category, minute, action)) GROUP BY ALL),
dated AS (SELECT *, lead(minute) OVER (PARTITION BY pattern, category ORDER BY minute) AS until FROM entries),
asked AS (
  SELECT page_id, fetched, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM seen, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS r(i) WHERE host <> ''
  UNION
  SELECT page_id, fetched, host || '/' || array_to_string(parts[:i], '/') FROM seen, unnest(range(1, len(parts) + 1)) AS r(i) WHERE host <> ''),
active AS (
  SELECT a.page_id, d.pattern, d.category, d.minute AS since,
    row_number() OVER (PARTITION BY a.page_id ORDER BY length(d.pattern) DESC, d.category <> 'allow', d.category, d.pattern) AS place,
    count(*) OVER (PARTITION BY a.page_id) AS n
  FROM asked AS a JOIN dated AS d ON a.pattern = d.pattern AND d.action = 'add' AND d.minute <= a.fetched AND (d.until IS NULL OR a.fetched < d.until))
SELECT s.page_id, s.url, s.fetched, coalesce(a.category = 'allow', true) AS kept, coalesce(a.n, 0)::BIGINT AS n_active, a.pattern, a.category, a.since
FROM seen AS s LEFT JOIN active AS a ON a.page_id = s.page_id AND a.place = 1
"""

ORACLES: dict[str, str] = {"op5_warc": OP5_SQL, "op10_url_filters": OP10_SQL}
