"""From documents to token ids: quality rules, line dedup, n-gram join, mix of sources, BPE.

Each stage gets all that the one before it kept, as a written table, and returns the columns of ``documents``; the last one
returns ``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit integers), ``ids_sha256`` and ``decoded_sha256``. A document
that the mix takes twice is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colonnade.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from colonnade.llm.frames import staged
from colonnade.llm.queries import table, vocabulary_path


#: Rows that go to a Python worker at once: whole texts, of which the usual number would fill its memory.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded(spark)
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, folder, "labels")))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded(spark)
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded(spark)
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    bounded(spark)
    return bpe.digests(docs, vocabulary_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mix), ("bpe", tokens),
]
#: SQL expresses neither the learned rules nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)


REGISTRY = {"pipeline": run}
SQL: dict[str, str] = {}
