"""From raw documents to token files: the corpus operators in their order, each on what the last one kept.

Toxic documents go, then all but one document of every group of near-copies, then documents with
benchmark passages; what is left is mixed to the source weights (rows repeat as often as their
copies) and written as token files. Every stage takes and, but for the last, returns the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import decontaminate, mix, simhash, tokens, toxicity, work
from clickloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labels and drop the documents that score as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_harmless(docs, toxicity.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every component of near-copies."""
    return simhash.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until every source has its share of the words."""
    return mix.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what they hold of every document."""
    return tokens.encoded(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("token_ids", write_tokens),
]

#: Learnt lexicons, fingerprints and tokenizers have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.store(docs, name)
    return docs
