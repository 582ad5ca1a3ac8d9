"""The queries of the text operators over the given tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colonnade.llm import (
    bpe, centroid_clusters, conversations, html_text, line_dedup, mixing, ngram_join, quality_rules, secret_scan, spot_signatures,
    suffix_dedup, toxicity, url_filter,
)
from colonnade.llm.frames import map_rows

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of the queries that SQL can express.
SQL: dict[str, str] = {}
VOCABULARY = "word_bpe_49k.json"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    labelled = pages.select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id"))
    return url_filter.judge(pages, URL_RULES, url_filter.fit(labelled, id_col="page_id")).withColumnRenamed("id", "page_id")


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    return quality_rules.judge(docs, rules).withColumnRenamed("id", "doc_id")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), "score", "predicted").withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(table(spark, folder, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.with_bitmaps(table(spark, folder, "documents"))

    def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, text, n_lines, n_dropped, keep in rows:
            rest = line_dedup.apply_bitmap(text, keep).encode("utf-8", "surrogatepass")
            yield doc, n_lines, n_dropped, hashlib.sha256(rest).hexdigest()

    needed = kept.select("source.doc_id", "source.text", "n_lines", "n_dropped", "keep")
    return map_rows(needed, digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


@query
def op8_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    found = spot_signatures.compare_neighbours(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        spot_signatures.fingerprint(F.col("own")).alias("fingerprint"), spot_signatures.fingerprint(F.col("changed")).alias("edited_fingerprint"),
        spot_signatures.likeness(F.col("own"), F.col("changed")).alias("near_edited"), spot_signatures.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


@query
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    return conversations.digests(conversations.damaged(given), given)


#: Parameters of the clusters.
CENTROIDS, ROUNDS, COMPONENTS = 40, 5, 64


@query
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, history = centroid_clusters.cluster(table(spark, folder, "embeddings"), CENTROIDS, ROUNDS, dims=COMPONENTS)
    return centroid_clusters.with_inertia(found, history).withColumnRenamed("id", "vec_id")


SQL["op12_centroid_clusters"] = centroid_clusters.sql(CENTROIDS, ROUNDS, COMPONENTS)


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


SQL["op13_secret_scan"] = secret_scan.sql()
