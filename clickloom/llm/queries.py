"""One query per operator, with production parameters, over its whole table; the SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import alignment, audit, decontaminate, language, mix, quality, quartile, secrets, setjoin, simhash, tokens, toxicity, warc, work

#: Folder of the public vocabularies; by default that of the installed package.
TOKENIZERS = os.environ.get("CLICKLOOM_TOKENIZERS")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that a mix of all sources takes of every document."""
    return mix.mix(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in every document."""
    return decontaminate.passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-copies of every document."""
    return simhash.classes(_table(spark, sf_dir, "documents")).drop("fp")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a fifth by id is held out of training."""
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(work.remainder("doc_id", 5) != 0), language.read_pieces(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    held_out = F.coalesce(work.remainder("doc_id", 5) == 0, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document and whether the resample takes it."""
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from directly addressable files."""
    docs = tokens.encoded(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third by id is held out of training."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(work.remainder("doc_id", 3) != 1))
    held_out = F.coalesce(work.remainder("doc_id", 3) == 1, F.lit(False))
    predicted = (F.col("score") >= toxicity.REJECT).cast("int")
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document and of its edited text, and their likeness."""
    return quartile.chain(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set and component of linked sets of every document."""
    return setjoin.classes(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the 120 orders of five filters keeps and removes, by part and step."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers, and how usual its links are."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as a, open(tokenizer_path("piece_bpe_32k.model"), "rb") as b:
        return alignment.alignment(_table(spark, sf_dir, "documents"), a.read(), b.read())


QUERIES = {f.__name__: f for f in (op1_mix, op2_decontaminate, op3_simhash, op4_language, op5_warc, op6_quality, op7_token_ids, op8_toxicity, op9_quartile_digest, op10_secrets, op11_shingle_join, op12_filter_audit, op13_alignment)}
ORACLES: dict[str, str] = {"op5_warc": warc.SQL, "op12_filter_audit": audit.SQL}
