"""Tables made of parts, each written once and live from its commit on; a commit may replace other parts.

A commit is one small file, and its job's last step is a rename: a run that breaks before it leaves the table as it was. What
a commit replaced is emptied after it, so its rows are in no file any more; `swept` does that again for a run that broke in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMITS = "part string, replaces array<string>, at_us long, facts map<string, string>"


def created(spark: SparkSession, folder: str) -> str:
    """The folder of a new table without parts."""
    spark.createDataFrame([], COMMITS).write.mode("append").json(f"{folder}/commits")
    return folder


def new_part() -> str:
    return uuid.uuid4().hex


def live(spark: SparkSession, folder: str) -> list[Row]:
    """The commits whose parts hold: a row a part."""
    rows = spark.read.schema(COMMITS).json(f"{folder}/commits").collect()
    gone = {p for r in rows for p in r["replaces"] or ()}
    return sorted((r for r in rows if r["part"] not in gone), key=lambda r: (r["at_us"], r["part"]))


def commit(spark: SparkSession, folder: str, part: str, facts: dict[str, object], replaces: list[str] = ()) -> None:
    """From now on part holds, and those that it replaces don't."""
    commit_all(spark, folder, [(part, list(replaces), facts)])


def commit_all(spark: SparkSession, folder: str, parts: list[tuple[str, list[str], dict[str, object]]]) -> None:
    """Several parts (name, what it replaces, facts) from one moment on: one file has them all."""
    rows = [(part, replaces, {k: str(v) for k, v in facts.items()}) for part, replaces, facts in parts]
    df = spark.createDataFrame(rows, "part string, replaces array<string>, facts map<string, string>")
    df.select("part", "replaces", F.unix_micros(F.current_timestamp()).alias("at_us"), "facts").coalesce(1).write.mode("append").json(f"{folder}/commits")


def read(spark: SparkSession, folder: str, table: str, parts: list[str], schema: str) -> DataFrame:
    """The rows of the given parts of a table; only their files are listed and read."""
    paths = [f"{folder}/{table}/part={p}" for p in parts]
    df = spark.read.schema(schema)
    return df.option("basePath", f"{folder}/{table}").parquet(*paths) if paths else spark.createDataFrame([], schema)


def swept(spark: SparkSession, folder: str, tables: dict[str, str]) -> list[str]:
    """Empties the files of all parts that were replaced; tables: name and schema. Returns their names."""
    rows = spark.read.schema(COMMITS).json(f"{folder}/commits").collect()
    gone = sorted({p for r in rows for p in r["replaces"] or ()})
    for part in gone:
        for table, schema in tables.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{table}/part={part}")
    return gone
