"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import (
    alignment,
    decontamination,
    fill_middle,
    lines,
    packing,
    pivots,
    quality_model,
    rule_lists,
    secrets,
    segmentation,
    simhash,
    suffix_dedup,
    token_counts,
)
from reelspark.llm.vocabulary import public_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, folder, "embeddings"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"), public_path("byte_bpe_50k.tiktoken"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, folder, "documents"), public_path("byte_bpe_50k.tiktoken"))


def sampled_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return segmentation.sample(documents, ["doc_id"], "text", public_path("piece_bpe_32k.model"), k=4)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return rule_lists.judge(documents, rule_lists.learn_from(documents, table(spark, folder, "labels")))


def power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_path("word_bpe_49k.json"))


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, folder, "documents"))


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(table(spark, folder, "documents"))


def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    return alignment.align(table(spark, folder, "documents"), *paths, hashed=True)


QUERIES = {
    "op1_quality_classifier": quality_classifier,
    "op2_simhash_near_dedup": simhash_near_dedup,
    "op3_embedding_near_dedup": embedding_near_dedup,
    "op4_secret_scan": secret_scan,
    "op5_line_dedup": line_dedup,
    "op6_token_counts": token_count,
    "op7_sampled_segmentations": sampled_segmentations,
    "op8_quality_rules": quality_rules,
    "op9_power_of_two_packing": power_of_two_packing,
    "op10_suffix_array_dedup": suffix_array_dedup,
    "op11_benchmark_decontamination": benchmark_decontamination,
    "op12_fill_in_middle": fill_in_middle,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

#: SQL equivalents.  The others' results depend on a fitted model, a tokenizer or a hash that SQL lacks; they are
#: tested against brute force instead.
ORACLES: dict[str, str] = {
    "op11_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
}
