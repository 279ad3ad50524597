"""Instruction profiles: which records can serve a profile, and weighted choices among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import TELUGU
from ..functions.prosody import lines, strip
from .curate import hashed


def _said(column: str) -> Column:
    return F.coalesce(strip(F.col(column)), F.lit(""))


def _glossed() -> Column:
    return F.coalesce(F.size(F.map_keys("word_to_word_meaning")), F.lit(0))


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def checks(columns: list[str]) -> dict[str, Column]:
    """What a record offers, as conditions on its fields. A table without one of the tag columns offers no tags."""
    line = F.col("chandassu_analysis.line_1")
    letter = F.lit(f"'([{TELUGU}])'")
    n_tags = lambda c: F.coalesce(F.size(c), F.lit(0)) >= 2 if c in columns else F.lit(False)
    return {
        "poem": F.length(_said("poem")) > 5,
        "two_lines": _true(F.size(lines(F.col("poem"))) >= 2),
        "english_meaning": _said("english_meaning") != "",
        "telugu_meaning": _said("telugu_meaning") != "",
        "gloss_rich": _glossed() >= 3,
        "gloss_any": _glossed() >= 1,
        "analysis": _true(line.isNotNull() & F.col("chandassu_analysis.line_2").isNotNull()),
        "rhyme_letter": _true(F.regexp_count(line["prasa_check"], letter) >= 1),
        "alliteration_letters": _true(F.regexp_count(line["yati_check"], letter) >= 2),
        "breakdown": _true(F.length(line["breakdown"]) > 10),
        "tags_telugu": n_tags("tags_telugu"),
        "tags_english": n_tags("tags_english"),
        "source": _said("source") != "",
        "long_first_line": _true(F.length(strip(F.substring_index("poem", "\n", 1))) >= 8),
        "telling_meaning": F.length(_said("telugu_meaning")) >= 20,
    }


# What each profile needs. Analysis, retrieval, generation, support.
NEEDS = {
    "AN1": ("poem", "analysis", "breakdown"),
    "AN2": ("poem", "analysis", "breakdown"),
    "AN3": ("poem", "analysis"),
    "AN4": ("poem", "gloss_rich"),
    "AN5": ("poem", "gloss_rich", "telugu_meaning"),
    "AN6": ("two_lines", "breakdown"),
    "RT1": ("two_lines",),
    "RT2": ("two_lines",),
    "RT3": ("two_lines",),
    "RT4": ("poem", "english_meaning"),
    "RT5": ("poem", "telugu_meaning"),
    "RT6": ("two_lines", "long_first_line"),
    "GN1": ("poem", "english_meaning"),
    "GN2": ("poem", "english_meaning"),
    "GN3": ("poem", "telugu_meaning"),
    "GN4": ("two_lines",),
    "GN5": ("poem", "english_meaning", "rhyme_letter"),
    "GN6": ("poem", "english_meaning", "alliteration_letters"),
    "GN7": ("poem", "telugu_meaning", "telling_meaning"),
    "GN8": ("two_lines", "telugu_meaning"),
    "SP1": ("poem", "analysis", "rhyme_letter"),
    "SP2": ("poem", "analysis", "alliteration_letters"),
    "SP3": ("poem", "analysis", "breakdown"),
    "SP4": ("poem", "analysis", "gloss_rich"),
    "SP5": ("poem", "analysis", "gloss_any", "telugu_meaning"),
    "SP6": ("poem", "analysis", "gloss_rich"),
}


def offered(df: DataFrame) -> DataFrame:
    """``df`` with one boolean column ``_has_...`` per check, none of them null."""
    return df.withColumns({f"_has_{name}": cond for name, cond in checks(df.columns).items()})


def feasible(df: DataFrame, id_col: str) -> DataFrame:
    """``id`` and one boolean column per profile. Null, blank and missing fields count as not offered."""
    cols = []
    for name, needs in NEEDS.items():
        cond = F.lit(True)
        for n in needs:
            cond = cond & F.col(f"_has_{n}")
        cols.append(cond.alias(name))
    return offered(df).select(F.col(id_col).alias("id"), *cols)


def shares(df: DataFrame, names: list[str]) -> DataFrame:
    """``name``, ``n``, ``pct`` of the rows where each boolean column holds; an empty table has no rows with a share."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(n)).alias(n) for n in names])
    return one.unpivot(["total"], names, "name", "n").select("name", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def coverage_verdict(pct: Column) -> Column:
    """Coverage of a field: good from 80 %, partial from 40 %, sparse below."""
    return F.when(pct >= 80, "good").when(pct >= 40, "partial").otherwise("sparse")


def profile_verdict(pct: Column) -> Column:
    """Use of a profile: keep from 80 %, keep in part from 50 %, risky from 20 %, drop below."""
    return F.when(pct >= 80, "keep").when(pct >= 50, "partial").when(pct >= 20, "risky").otherwise("drop")


def uniform(seed: int, *ids: Column) -> Column:
    """A number of the open interval (0, 1) from a seed and identifiers, the same in any engine that knows MD5."""
    return (F.conv(F.substring(hashed(seed, *ids), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 1)


def draw(feas: DataFrame, weights: dict[str, float], k: int, seed: int) -> DataFrame:
    """``id``, ``profiles``: up to ``k`` different feasible profiles per record, drawn by weight without replacement.

    Every profile gets the key -ln(u) / weight from a hash of record and profile; the smallest keys
    are the draw, which has the distribution of drawing one by one, the weights of the feasible
    profiles renormalised each time.
    """
    keys = F.array_compact(F.array(*[F.when(F.col(p), F.struct((-F.log(uniform(seed, F.col("id"), F.lit(p))) / w).alias("key"), F.lit(p).alias("name"))) for p, w in weights.items()]))
    return feas.select("id", F.transform(F.slice(F.array_sort(keys), 1, k), lambda x: x["name"]).alias("profiles"))


def exploded(drawn: DataFrame, split: Column, test_profile: str) -> DataFrame:
    """``id``, ``split``, ``profile_id``, ``place``: a row per drawn profile; records of the test split have the one ``test_profile``.

    A record without a drawn profile has no row outside the test split.
    """
    given = F.when(F.col("split") == "test", F.array(F.lit(test_profile))).otherwise(F.col("profiles"))
    return drawn.withColumn("split", split).select("id", "split", F.posexplode(given).alias("place", "profile_id")).select("id", "split", "profile_id", "place")


def tiered(df: DataFrame, id_col: str, seed: int, both: str = "AN5", other: str = "AN4", share: float = 0.55) -> DataFrame:
    """``id``, ``profile_id``: the stricter profile with ``share`` where a record can serve both, else the other, else none (no row)."""
    f = feasible(df, id_col)
    first = F.when(F.col(both), F.when(uniform(seed, F.col("id")) < share, both).otherwise(other)).when(F.col(other), other)
    return f.select("id", first.alias("profile_id")).filter("profile_id is not null")


def keywords(df: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """``id``, ``keywords``: the first ``n`` glossed words of a record in the order of its map, cut at ``+``."""
    keys = F.transform(F.map_keys("word_to_word_meaning"), lambda w: strip(F.substring_index(w, "+", 1)))
    return df.select(F.col(id_col).alias("id"), F.slice(keys, 1, n).alias("keywords"))
