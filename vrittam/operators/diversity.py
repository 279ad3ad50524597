"""Lexical diversity of texts and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import BLANKS


def words(text: Column) -> Column:
    """Words of a text, parted by white space."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda x: x != "")


def per_text(df: DataFrame, id_col: str, text_col: str, window: int = 2) -> DataFrame:
    """``id``, ``n_words``, ``ttr``, ``mattr`` (moving window), ``yules_k``, ``honores_h`` of every text with words.

    Narrow: arrays within the row. One word gives K = 0; all-unique words are given half a repeated
    one in H.
    """
    w = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.size("w")).withColumn("types", F.array_distinct("w"))
    w = w.withColumn("f", F.transform("types", lambda t: F.size(F.filter("w", lambda x: x == t)))).withColumn("v", F.size("types"))
    w = w.withColumn("v1", F.size(F.filter("f", lambda x: x == 1))).withColumn("sq", F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x))
    ttr = F.col("v") / F.col("n")
    at = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    moving = F.aggregate(F.transform(at, lambda i: F.size(F.array_distinct(F.slice("w", i, window))) / F.lit(float(window))), F.lit(0.0), lambda a, x: a + x) / F.size(at)
    k = F.when(F.col("n") == 1, 0.0).otherwise(1e4 * (F.col("sq") - F.col("n")) / (F.col("n").cast("double") * F.col("n")))
    h = 100.0 * F.log(F.col("n").cast("double")) / (1.0 - F.when(F.col("v1") == F.col("v"), F.col("v1") - 0.5).otherwise(F.col("v1").cast("double")) / F.col("v"))
    return w.select("id", F.col("n").cast("bigint").alias("n_words"), ttr.alias("ttr"), F.when(F.col("n") <= window, ttr).otherwise(moving).alias("mattr"), k.alias("yules_k"), h.alias("honores_h"))


def frequencies(df: DataFrame, text_col: str) -> DataFrame:
    """``word``, ``n`` over all texts."""
    return df.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corpus(df: DataFrame, text_col: str) -> DataFrame:
    """One row: words, vocabulary, TTR, hapax and dis legomena, Yule's K, Honoré's H, Sichel's S, from the frequency spectrum."""
    spectrum = frequencies(df, text_col).groupBy("n").agg(F.count(F.lit(1)).alias("v"))
    s = spectrum.agg(
        F.sum(F.col("n") * F.col("v")).alias("n_words"),
        F.sum("v").alias("n_types"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("v"))), F.lit(0)).alias("hapax"),
        F.coalesce(F.sum(F.when(F.col("n") == 2, F.col("v"))), F.lit(0)).alias("dis"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("v")).alias("sq"),
    )
    n, v, v1 = F.col("n_words").cast("double"), F.col("n_types"), F.col("hapax")
    return s.select(
        "n_words",
        "n_types",
        "hapax",
        "dis",
        (v / n).alias("ttr"),
        (v1 / v).alias("hapax_ratio"),
        (F.col("dis") / v).alias("sichels_s"),
        F.when(F.col("n_words") == 1, 0.0).otherwise(1e4 * (F.col("sq") - n) / (n * n)).alias("yules_k"),
        (100.0 * F.log(n) / (1.0 - F.when(v1 == v, v1 - 0.5).otherwise(v1.cast("double")) / v)).alias("honores_h"),
    )


def grouped_mattr(df: DataFrame, id_col: str, text_col: str, window: int = 50) -> DataFrame:
    """Moving TTR over the corpus with equal words side by side, in the order of their first use.

    In such a sequence a window holds one type more than the word borders inside it, so the mean
    needs no window: each border at distance ``b`` from the start lies in ``min(b, window - 1, n - b,
    n - window + 1)`` windows. The running sum of counts is the only ordered step; it is made in
    blocks by range, so no task sees all types.
    """
    pos = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(words(F.col(text_col))).alias("p", "word"))
    types = pos.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "p")).alias("first"))
    ordered = types.select("n", "first").repartitionByRange("first").sortWithinPartitions("first").withColumn("part", F.spark_partition_id())
    from ..scratch import materialise

    ordered = materialise(ordered.select("part", "first", "n"), "types")
    sums = ordered.groupBy("part").agg(F.sum("n").alias("s"))
    # a row per partition: few enough for one task
    order = Window.orderBy("part")
    before = sums.select("part", F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    border = ordered.withColumn("run", run).drop("n").join(F.broadcast(before), "part").select((F.col("before") + F.col("run")).alias("b"), "n")
    held = F.least(F.col("b"), F.lit(window - 1), F.col("n") - F.col("b"), F.col("n") - window + 1)
    inside = F.col("b") < F.col("n")
    body = border.agg(F.coalesce(F.sum(F.when(inside, held)), F.lit(0)).alias("held"), F.count_if(inside).alias("borders"), F.max("n").alias("n"))
    wins = F.col("n") - window + 1
    return body.filter("n > 0").select(F.when(F.col("n") <= window, (F.col("borders") + 1) / F.col("n")).otherwise((wins + F.col("held")) / (wins * F.lit(float(window)))).alias("mattr"))
