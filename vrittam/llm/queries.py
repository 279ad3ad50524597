"""Queries of the language-model operators and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import table
from . import budget, curation, defects, encode, lookalikes, packing, quality


def p1_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens by source, language, domain and flag."""
    return budget.token_budget(table(spark, sf_dir, "dwipada_augmented_dataset"), table(spark, sf_dir, "source_works"))


def p1_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every poem."""
    out = budget.estimate(table(spark, sf_dir, "dwipada_augmented_dataset").select("rec_id", "poem"), "poem")
    return out.selectExpr("rec_id", "_language as language", "round(_tokens, 2) as n_tokens")


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every poem in its canonical form."""
    out = lookalikes.canonical_text(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem")
    return out.withColumnRenamed("id", "rec_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookalikes.lookalike_pairs(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem")
    return out.selectExpr("id_a as rec_id_a", "id_b as rec_id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = defects.broken_answers(table(spark, sf_dir, "benchmark_results"), "result_id", "prompt", "raw_output", "extracted_poem")
    return out.withColumnRenamed("id", "result_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or of the pieces of a document longer than one."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality.text_quality(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_statistics(spark, sf_dir).filter("not connected").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **curation.QUERIES,
    "p1_budget": p1_budget,
    "p1_estimates": p1_estimates,
    "p2_canonical": p2_canonical,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

ORACLE_SQL: dict[str, str] = {}
