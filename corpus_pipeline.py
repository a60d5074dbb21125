"""A corpus through five operators: language, quality rules, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineamark.llm import langid, ngram_join, packing, pii, quality_rules
from lineamark.llm.shared import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labels in docs; texts in none of them, or without a letter, go."""
    return langid.accepted(docs, langid.learn(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Short, repetitive and depleted documents go."""
    return quality_rules.keep(docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of common 5-word shingles, the one with the least id stays."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    return pii.replace(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", known_language),
    ("quality rules", quality),
    ("n-gram Jaccard join", first_of_near_copies),
    ("PII", private_data),
    ("packing", packed),
]

#: SQL can't express the network, the tokenizer or the packing; tests/llm holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
