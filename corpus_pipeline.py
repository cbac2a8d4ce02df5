"""A corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents. Rows with a null text or id are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from footfall.llm.queries import BYTE_BPE, toxic_chain
from footfall.sources.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of texts that go to a Python worker at once. By default 64 MB do: a whole task's texts, held several times over by
#: the executor and by its workers, which keep the memory while later stages run.
BATCH = "1m"


def _small_batches(spark: SparkSession) -> None:
    """Rows go to Python in small batches from here on; which rows share a batch changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers holds toxic go."""
    _small_batches(spark)
    scored = toxicity.classify(docs, toxic_chain(docs, sf_dir), COLUMNS)
    return scored.where(F.col("p_toxic") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    _small_batches(spark)
    copies = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source has its share of the words: a document that the mix takes several times is there several times."""
    sized = docs.select(*COLUMNS, F.array("source").alias("sources"), mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, "sources", "size").where(F.col("times") > 0)
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of the ids and of the text decoded from them."""
    _small_batches(spark)
    return bpe.digest(bpe.round_trip(docs, BYTE_BPE, bpe.build_lexicon(docs, BYTE_BPE)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot state the classifier, the signatures and the tokenizer; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
