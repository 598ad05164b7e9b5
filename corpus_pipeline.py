"""The corpus pipeline: documents judged, cleaned, deduplicated, scanned and packed, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import lines, near_texts, packing, quality_model, secrets
from reelspark.llm.rows import stored
from reelspark.llm.vocabulary import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.accepted(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of the corpus go from the texts, within the limits of ``op5_line_dedup``."""
    return lines.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts with a Jaccard similarity of 0.8 or more (five words) the one with the smallest id stays.

    SimHash fingerprints by Golay-code keys, as in ``op2_simhash_near_dedup``, name the first candidates.
    """
    return near_texts.first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    return secrets.redacted(docs, public_path("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences whose lengths are powers of two."""
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The classifier is fitted and the scans use tokenizers, so SQL cannot express the rows; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
