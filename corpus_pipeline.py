"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language ID drops documents without a language; line dedup removes lines that repeat
an earlier one; the n-gram join keeps one document of each near-duplicate component;
decontamination drops documents that a benchmark item leaks into; mixing repeats or
drops documents so that sources reach their targets (its rows carry ``copy``'s
repetitions as rows of their own).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from conceptlake.llm import decontamination, language, line_dedup, mixing, ngram_join
from conceptlake.llm.shared import drop_since, shared_dir, table, tables_now


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_ngrams),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Language ID and decontamination can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = tables_now()
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        drop_since(before)
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
