"""Filters that say why a record leaves, exclusions, and results kept beside their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prosody import strip
from . import metre


def sections_reason(df: DataFrame, *sections: str) -> DataFrame:
    """``df`` with ``reason``: the sections that are null or blank, by name, or null if all are there."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", c) for c in sections]))
    return df.withColumn("reason", F.when(F.size(missing) > 0, F.concat(F.lit("empty sections: "), F.array_join(missing, ", "))))


def score_reason(df: DataFrame, poem: str, wanted: float = 100.0) -> DataFrame:
    """``df`` with ``overall`` and ``reason``: null for couplets of the wanted score, else the score or that there are fewer than two lines."""
    got = metre.analysed(df, poem)
    got = metre.once(got.select(*df.columns, "overall", "error"))
    return got.withColumn("reason", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("overall") != wanted, F.concat(F.lit("score="), F.format_string("%.1f", "overall"))))


def split_by_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, without the column; and the rejected ones with it."""
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null")


def without(df: DataFrame, column: Column, excluded: list[str]) -> DataFrame:
    """Rows whose value is none of ``excluded`` (sources, splits); rows of a null value stay."""
    return df.filter(F.coalesce(~column.isin(*excluded), F.lit(True))) if excluded else df


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those already done, as a crawl goes on after a checkpoint; rows of a null key stay."""
    return df.join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def dual_output(df: DataFrame, order: str, payload: list[str], metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """The payload and, apart, the metadata of the same rows, joined again by :func:`with_sidecar`; ``line`` is the row's unique key."""
    keyed = df.withColumn("line", F.col(order))
    return keyed.select("line", *payload), keyed.select("line", *metadata)


def with_sidecar(payload: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Payload rows with their metadata by ``line``; rows without any keep nulls."""
    return payload.join(sidecar, "line", "left")


def validator(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``valid_lines`` (of the first two), ``all_valid``: what a generator keeps an answer for.

    A line is valid if its feet are, whether or not there is a second; texts of fewer than two lines are never all valid.
    """
    got = metre.analysed(df, text)
    fine = [F.coalesce(F.col(f"feet{k}.valid") == 4, F.lit(False)) for k in "12"]
    return got.withColumn("valid_lines", fine[0].cast("int") + fine[1].cast("int")).withColumn("all_valid", F.coalesce(F.col("is_valid"), F.lit(False)))


def benchmark_breakdown(df: DataFrame, text: str, *groups: str) -> DataFrame:
    """``groups``, poems and valid ones, lines and valid ones, and the accuracies in per cent; groups of no lines have none for lines."""
    got = validator(df, text)
    n_lines = F.when(F.col("line2").isNotNull(), 2).when(F.col("line1").isNotNull(), 1).otherwise(0)
    sums = got.groupBy(*groups).agg(F.count(F.lit(1)).alias("poems"), F.count_if("all_valid").alias("valid_poems"), F.sum(n_lines).alias("lines"), F.sum("valid_lines").alias("valid_lines"))
    return sums.withColumn("poem_accuracy", F.round(F.col("valid_poems") * 100.0 / F.col("poems"), 4)).withColumn("line_accuracy", F.round(F.when(F.col("lines") > 0, F.col("valid_lines") * 100.0 / F.col("lines")), 4))
