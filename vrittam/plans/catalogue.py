"""All queries of the core in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import corpus, letters, records, verse

QUERIES = {**verse.QUERIES, **corpus.QUERIES, **letters.QUERIES, **records.QUERIES}
ORACLE_SQL = {**verse.ORACLE_SQL, **corpus.ORACLE_SQL, **letters.ORACLE_SQL, **records.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["source_purity"](spark, sf_dir)
