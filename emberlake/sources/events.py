"""The event table: fixed columns, and a JSON bag `fields` of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First nine: what producers send; the rest is derived on append.
EVENTS = (
    "event_ts timestamp_ntz, host string, service string, source string, environment string, severity string, log_type string, message string, fields string, "
    "schema_version int, event_id string, ingest_time timestamp_ntz, raw_payload_hash string, parser_name string, source_trust string, collector_id string"
)
#: Synthetic security events over the driver's table `events`; the text means the same to Spark and DuckDB.
DERIVED = {
    "event_id": "event_id",
    "event_ts": "ts",
    "ingest_time": "ts + INTERVAL '2' SECOND",
    "environment": "CASE WHEN user_id % 9 = 0 THEN 'test' ELSE 'prod' END",
    "host": "concat('host-', user_id % 12)",
    "service": "CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sudo' WHEN 'purchase' THEN 'postgres' ELSE 'web' END",
    "source": "CASE WHEN user_id % 3 = 0 THEN 'journald' WHEN user_id % 3 = 1 THEN 'syslog' ELSE 'pgaudit' END",
    "severity": "CASE WHEN event_type = 'error' THEN 'warning' ELSE 'info' END",
    "log_type": "CASE WHEN event_type = 'purchase' THEN 'audit' ELSE 'system' END",
    "collector_id": "CASE WHEN user_id % 7 <> 0 THEN concat('col-', user_id % 5) END",
    "value": "value",
    "message": "concat(CASE event_type WHEN 'error' THEN 'Failed password for user' WHEN 'signup' THEN 'Accepted password for user' ELSE event_type END, ' u', user_id, ' from 10.0.', user_id % 4, '.', user_id % 50, ' port ', CAST(floor(value * 100) AS BIGINT))",
    "fields": "concat('{\"db_user\":\"u', user_id, '\",\"src_ip\":\"10.0.', user_id % 4, '.', user_id % 50, '\",\"target_person\":\"p', event_id % 97, '\"', CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN ',\"ticket\":\"\"' ELSE concat(',\"ticket\":\"T', event_id % 1000, '\"') END, '}')",
}


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{sql} AS {name}" for name, sql in DERIVED.items()])


def derived_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in DERIVED.items()) + " FROM events"


def field(key: str, fields: str = "fields") -> Column:
    """A value of the JSON bag; null where the key is missing."""
    return F.get_json_object(fields, f"$['{key}']")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def stamped(rows: DataFrame, collector: str | None = None) -> DataFrame:
    """The nine payload columns of rows with the derived ones: identity, hashes and provenance, in the table's order."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("host", "source", "service", "message", "fields")]
    out = rows.withColumns({
        "schema_version": F.lit(2),
        "event_id": F.sha2(F.concat_ws("\x00", micros("event_ts").cast("string"), *parts), 256),
        "ingest_time": F.lit(None).cast("timestamp_ntz") if "ingest_time" not in rows.columns else F.col("ingest_time"),
        "raw_payload_hash": F.sha2("message", 256),
        "parser_name": F.col("source"),
        "source_trust": F.lit("authenticated" if collector else "unverified"),
        "collector_id": F.lit(collector).cast("string"),
    })
    return out.select(*[c.split()[0] for c in EVENTS.split(", ")])


def append(rows: DataFrame, path: str) -> None:
    """Appends stamped rows by day; a bloom filter on the id serves lookups of single events."""
    by_day = rows.withColumn("day", F.to_date("event_ts"))
    by_day.write.mode("append").partitionBy("day").option("parquet.bloom.filter.enabled#event_id", "true").option("compression", "zstd").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The event table; columns that older files lack are null."""
    return spark.read.schema(EVENTS + ", day date").parquet(path)
