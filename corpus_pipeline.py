"""From raw documents to packed training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import contamination, jaccard, passages, quality, sequences, store

#: The stages train a classifier and sketch passages; SQL cannot say them.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    On five-word shingles at a similarity of 0.8 or more.
    """
    groups = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    return store.without_ids(docs, groups.filter("component_id <> doc_id"), "doc_id")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; a document left without words goes."""
    cut = passages.without_passages(docs, passages.repeated_passages(docs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return store.without_ids(docs, contamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "doc_id")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens."""
    return sequences.pattern_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again, and goes when the next one is written.

    Rows with null texts, null ids or repeated ids go through every stage by
    its own rules; further columns stay until the last stage.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = store.new_path(spark, f"pipeline-{name}")
        docs = store.written_at(stage(spark, docs, sf_dir), path)
        if before:
            store.remove(spark, before)
        before = path
    return docs
