"""Queries of the subpackage, each one operator over its whole tables, and their SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, embed, lm, minhash, pii, quality, substrings, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(_documents(spark, sf_dir)).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), tokenizer_path())


#: For the queries only; real data need a secret of their own.
QUERY_KEY = b"a key for these queries"


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals, so that sums in any order give the same value."""
    scored = lm.score(_documents(spark, sf_dir), training=_remainder(7) != 2)
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_documents(spark, sf_dir), QUERY_KEY)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: tells the rows to learn from from those held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, keep=_remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embed.components(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, keep=_remainder(4) != 2)
    return quality.score(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_pii": op2_pii,
    "op3_minhash": op3_minhash,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_array": op6_suffix_array,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_embedding": op9_embedding,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {"op1_lm": lm.SCORE_SQL, "op6_suffix_array": substrings.DIGESTS_SQL, "op9_embedding": embed.COMPONENTS_SQL, "op3_minhash": minhash.COMPONENTS_SQL, "op7_chat": chat.FORMAT_SQL, "op8_decontamination": decontam.REPORT_SQL}
