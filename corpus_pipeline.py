"""From raw documents to training sequences: quality, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commerce_marts.llm import jaccard_join, mixing, packing, quality, queries, secret_scan
from commerce_marts.llm.common import free_names, settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on the labels of rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    (score,) = free_names(docs, "score")
    return quality.score_documents(docs, model, score_col=score).filter(F.col(score) >= queries.LEAST_SCORE).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; documents that share an id stay apart."""
    return jaccard_join.keep_one(docs, settle(jaccard_join.similar_groups(docs), "groups"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    prefix = "secret_"
    while f"{prefix}spans" in map(str.lower, docs.columns):
        prefix += "_"
    clean = secret_scan.redact(secret_scan.find_secrets(docs, prefix=prefix), prefix=prefix).drop(f"{prefix}spans")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, settle(mixing.mix_sources(docs), "mix"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, in sequences."""
    return packing.pack_documents(docs, queries.TOKENIZER, with_ids=False)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixture),
    ("packing", sequences),
]

#: The classifier, the hashes of the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0])
    return docs
