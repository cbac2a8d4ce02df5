"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bpe,
    fill_in_middle,
    hnsw,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    piece_counts,
    secrets,
    spelling,
    style_tree,
    subspace_join,
    toxicity,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", F.array("source").alias("sources"), mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized, "sources", "size").select("doc_id", "size", "source_size", "target", "taken", "times")


#: The chain of the labels: poor quality first, then toxicity, which decides.
CATEGORIES = ["poor", "toxic"]


def toxic_chain(docs: DataFrame, folder: str) -> toxicity.Chain:
    """The chain fitted on those of the documents that the folder has labels for."""
    labels = table(docs.sparkSession, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    return toxicity.fit(docs, labels, CATEGORIES)


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxic_chain(docs, folder), ["doc_id"]).withColumn("toxic", F.col("p_toxic") >= 0.5)


@query
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.digest(bpe.round_trip(docs, BYTE_BPE, bpe.build_lexicon(docs, BYTE_BPE)))


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


ORACLE["op5_secrets"] = secrets.ORACLE_SQL


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.dedup_lines(docs))


ORACLE["op6_line_dedup"] = line_dedup.ORACLE_SQL


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, folder, "documents"), PIECE_BPE)


@query
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return subspace_join.linked_vectors(table(spark, folder, "embeddings"))


ORACLE["op8_embedding_dedup"] = subspace_join.ORACLE_SQL


@query
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return style_tree.extract(table(spark, folder, "pages"))


@query
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, folder, "documents")))


ORACLE["op11_fill_in_middle"] = fill_in_middle.ORACLE_SQL


@query
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))
