"""From raw documents to token ids: five stages, each an operator of the corpus subpackage.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns ids
of tokens. Between stages the documents are a written table, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, decontaminate, linededup, neardup, quality
from emberlake.llm.common import cut, table
from emberlake.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.keep_rest(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids; ids that don't decode to the text would end the run."""
    coded = bpe.encode(docs.withColumn("_sum", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("lang", "source", "_sum"))
    whole = F.when(F.xxhash64("decoded") == F.col("_sum"), F.col("ids")).otherwise(F.raise_error(F.lit("ids don't decode to their text")).cast("array<int>"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), whole.alias("ids"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("byte BPE", byte_bpe)]
#: SQL expresses neither expectation-maximisation nor MinHash's links; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
