"""A pipeline for training text: toxic documents go, one of each group of near-duplicates stays, documents with
benchmark passages go, personal data become pseudonyms, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text. None of the stages can be
said in SQL as a whole, since the first is a trained model.

Defined cases, alike in all stages: all columns of documents are kept as they are (extra ones too, whatever their names),
but for text and n_chars after the pseudonyms and the columns of the last stage; an empty table gives an empty result;
texts that are null or empty are clean, no near-duplicates of any other, hold nothing and have no tokens; very long texts
are treated whole. Rows that repeat an id: each is judged by its own text, except that near-duplicates take an id as one
node, so that all rows of the first id of a group stay and all others go; ties are thus settled by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, decontam, minhash, pii, toxicity
from corpusflow.llm.common import Scratch
from corpusflow.llm.queries import QUERY_KEY, tokenizer_path

ORACLE_SQL = None
#: Least similarity, in percent, of near-duplicates on shingles of five words; op3's own contract says 85.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5 stay; the model learns from the labels of docs that op5 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels, keep=F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest id of each group of near-duplicates stay."""
    return minhash.keep_first(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of ten words (or a whole shorter item) of benchmark stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms in their texts; n_chars, where there is one, is the new text's."""
    done = pii.pseudonymize(docs, QUERY_KEY, count=None)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text they decode to."""
    return bpe.digests(docs, tokenizer_path(), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", pseudonymize),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(i))
        scratch.keep(str(i))
    return docs
