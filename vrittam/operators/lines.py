"""Line-oriented texts: headers, body and notes, verse groups, couplets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prosody import strip

DAMAGED = r"\x{2026}|\.{4,}"
ANNOTATION = r"\[[^\]]*\]"


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``no`` (from 1), ``line``: stripped lines of every text."""
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "l")).select("id", (F.col("p") + 1).alias("no"), strip(F.col("l")).alias("line"))


def headers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``headers``: the leading ``# key: value`` lines as a map; the last of equal keys wins."""
    lines = F.transform(F.split(F.col(text_col), "\n"), strip)
    first = F.array_min(F.transform(lines, lambda x, i: F.when(~F.startswith(x, F.lit("#")), i).otherwise(F.lit(1 << 30))))
    kept = F.filter(F.slice(lines, F.lit(1), F.least(first, F.size(lines))), lambda x: F.contains(x, F.lit(":")))
    content = F.transform(kept, lambda x: strip(F.regexp_replace(x, "^#+", "")))
    entries = F.transform(content, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    # last wins: entries of later position replace earlier ones
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda z: z["k"] == e["k"]))
    return df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.map_from_entries(last).alias("headers"))


def groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``grp``, ``no``, ``line``: verse lines before a ``---`` line, in groups parted by blank and ``#`` lines.

    Bracketed notes are cut out of the lines; a line that is nothing else is dropped without parting
    its group.
    """
    per = Window.partitionBy("id").orderBy("no")
    n = numbered(df, id_col, text_col)
    n = n.withColumn("ended", F.max(F.when(F.col("line") == "---", 1).otherwise(0)).over(per)).filter("ended = 0")
    border = (F.col("line") == "") | F.startswith(F.col("line"), F.lit("#"))
    n = n.withColumn("grp", F.sum(F.when(border, 1).otherwise(0)).over(per)).filter(~border)
    return n.select("id", "grp", "no", strip(F.regexp_replace("line", ANNOTATION, "")).alias("line")).filter("line <> ''")


def couplets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``couplet_number``, ``line1``, ``line2``: neighbouring lines of every group, damaged ones left out.

    A group of two lines is one couplet, a longer one gives overlapping ones, a single line none.
    The windows are by text and group, whose lines are few.
    """
    g = groups(df, id_col, text_col).withColumn("line2", F.lead("line").over(Window.partitionBy("id", "grp").orderBy("no")))
    ok = g.filter(F.col("line2").isNotNull() & ~F.col("line").rlike(DAMAGED) & ~F.col("line2").rlike(DAMAGED))
    return ok.select("id", F.row_number().over(Window.partitionBy("id").orderBy("no")).alias("couplet_number"), F.col("line").alias("line1"), "line2")


def counters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Single lines, triplets, couplets kept and couplets discarded over all texts."""
    g = groups(df, id_col, text_col).withColumn("line2", F.lead("line").over(Window.partitionBy("id", "grp").orderBy("no")))
    bad = F.col("line").rlike(DAMAGED) | F.col("line2").rlike(DAMAGED)
    per = g.groupBy("id", "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line2").isNotNull() & bad).alias("bad"), F.count_if(F.col("line2").isNotNull() & ~bad).alias("good"))
    return per.agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") == 3).alias("triplets"), F.coalesce(F.sum("good"), F.lit(0)).alias("couplets"), F.coalesce(F.sum("bad"), F.lit(0)).alias("discarded"))


def zones(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``no``, ``zone``, ``line``: every line of a text, none dropped.

    Zones: ``header`` (leading ``#`` lines), ``footnote`` (from the first ``---`` line on), ``note`` (other
    ``#`` lines) and ``body``, whose lines alone are meant for cleaning. Narrow: a text is one row.
    """
    ls = F.split(F.col(text_col), "\n")
    far = F.lit(1 << 30)
    first = lambda cond: F.coalesce(F.array_min(F.transform(ls, lambda x, i: F.when(cond(x), i))), far)
    body = first(lambda x: ~F.startswith(x, F.lit("#")))
    tail = first(lambda x: strip(x) == "---")
    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), body.alias("_body"), tail.alias("_tail"), F.posexplode(ls).alias("p", "line"))
    zone = F.when(F.col("p") < F.col("_body"), "header").when(F.col("p") >= F.col("_tail"), "footnote").when(F.startswith("line", F.lit("#")), "note").otherwise("body")
    return rows.select("id", (F.col("p") + 1).alias("no"), zone.alias("zone"), "line")
