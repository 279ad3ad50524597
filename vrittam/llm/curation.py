"""Queries of the corpus operators: splits, near-duplicates, overlaps, copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_source
from . import copies, neardup, overlap, splits
from ..scratch import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = overlap.split_overlaps(table(spark, sf_dir, "ift_data"), "ift_id", "instruction", "output", "split")
    return out.selectExpr("least(eval_id, train_id) as ift_id_a", "greatest(eval_id, train_id) as ift_id_b")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and evaluation records by evaluation split and source."""
    ift = table(spark, sf_dir, "ift_data")
    found = overlap.Overlaps(ift, "ift_id", "instruction", "output", "split").counts()
    side = ift.select(F.col("ift_id").alias("eval_id"), "split", clean_source(F.col("source")).alias("source"))
    return found.join(side, "eval_id").groupBy("split", "source").agg(F.sum("n_train").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_records"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per couplet and its number of copies."""
    out = copies.copy_groups(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem")
    return out.selectExpr("first_id as rec_id", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies.copies_found(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem")
    return out.selectExpr("first_id as rec_id_first", "id as rec_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.linked_records(table(spark, sf_dir, "ift_data"), "ift_id", "output", "profile_id")
    return out.selectExpr("first_id as ift_id_first", "id as ift_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New split of every instruction record."""
    out = splits.grouped_splits(table(spark, sf_dir, "ift_data"), "ift_id", "output", "profile_id")
    return out.selectExpr("id as ift_id", "component as ift_id_first", "split as new_split")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = neardup.NearDuplicates(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem", "telugu_meaning")
    return op.pairs().selectExpr("id_a as rec_id_a", "id_b as rec_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate couplet records."""
    op = neardup.NearDuplicates(table(spark, sf_dir, "dwipada_augmented_dataset"), "rec_id", "poem", "telugu_meaning")
    return op.groups().withColumnRenamed("id", "rec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_copies": p7_copies,
    "p7_found": p7_found,
}

ORACLE_SQL: dict[str, str] = {}
