"""Group keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is hot. A key below it is small enough for one task's memory.
HOT_ROWS = 20_000
#: Parts into which a hot key is spread.
SALTS = 64
#: Rows up to which a written table of a few narrow columns is broadcast: some megabytes.
SMALL_ROWS = 200_000


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys ``on`` of a written table of exact counts that are hot, or nothing if none is.

    A key is hot from ``hot_rows`` rows, or from total / :data:`SMALL_ROWS` where that is more; so
    there are at most :data:`SMALL_ROWS` of them, however large the table.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    least = max(hot_rows, (total or 0) // SMALL_ROWS)
    return counts.filter(F.col(n) >= least).select(*on) if most and most >= least else None


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, salts: int = SALTS) -> DataFrame:
    """Inner equi-join whose hot keys are spread: left rows get one salt, right rows all of them.

    ``hot`` comes from :func:`hot_keys`, which bounds its size; its columns stand for ``on`` in
    their order. Rows of other keys get salt 0 on both sides, so nothing is copied for them.
    """
    if hot is None:
        return left.join(right, on)
    h = F.broadcast(hot.toDF(*on).withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    lhs = left.join(h, on, "left").withColumn("_salt", spread).drop("_hot")
    rhs = right.join(h, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return lhs.join(rhs, [*on, "_salt"]).drop("_salt")


def apart(rows: DataFrame, on: list[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of the keys ``hot`` of :func:`hot_keys`, without a shuffle."""
    if hot is None:
        return rows, None
    h = F.broadcast(hot.toDF(*on))
    return rows.join(h, on, "left_anti"), rows.join(h, on, "left_semi")


def small(written: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows, and without one beyond."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written
