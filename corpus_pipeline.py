"""From raw documents to packed token sequences: language, repeated lines, near copies, secrets, packing.

Each stage takes the documents that the one before it kept and returns documents with the same columns;
the last returns the packed pieces. ``n_chars`` follows a text that a stage changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import lang_id, line_dedup, ngram_join, packing, secret_scan
from lathework.llm.common import tokenizer_path
from lathework.session import materialize

#: A stage's decisions depend on trained models and on order within documents, which SQL cannot state.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go."""
    return lang_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words and more are deleted; a document that loses all its lines goes."""
    return _recounted(line_dedup.drop_repeated_runs(docs, keep_emptied=False))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles, at a similarity of 0.8, hold together, the smallest key stays."""
    return ngram_join.keep_representatives(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked; no document goes."""
    return _recounted(secret_scan.mask_secrets(docs, secret_scan.train(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
