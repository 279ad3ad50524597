"""Smaller selections: tags, ranges, prompt mixes, run grids, token coverage, outputs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .curate import hashed

#: Parts of speech that carry content.
CONTENT = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM")


def content_tags(tags: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Tagged tokens (structs with ``token`` and ``pos``) of content words that are no stop words."""
    return F.filter(tags, lambda t: t["pos"].isin(*CONTENT) & (~F.lower(t["token"]).isin(*stop_words) if stop_words else F.lit(True)))


def first_nouns(tags: Column, gloss: Column, n: int = 3) -> Column:
    """The first ``n`` nouns of a tagged text, or else its first glossed words, cut at ``+``."""
    nouns = F.transform(F.filter(F.coalesce(tags, F.array().cast("array<struct<token:string,pos:string>>")), lambda t: t["pos"].isin("NOUN", "PROPN")), lambda t: t["token"])
    keys = F.transform(F.map_keys(gloss), lambda k: F.trim(F.substring_index(k, "+", 1)))
    return F.slice(F.when(F.size(nouns) > 0, nouns).otherwise(F.coalesce(keys, F.array().cast("array<string>"))), 1, n)


def line_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1) in the order of a unique column: a top-k of ``last`` rows, not a sort of all."""
    head = df.orderBy(order).limit(last)
    return head.orderBy(F.desc(order)).limit(max(last - first + 1, 0)) if first > 1 else head


def short_texts(df: DataFrame, text_col: str, id_col: str, least: int = 20, most: int = 120, same: int = 30) -> DataFrame:
    """Texts of ``least`` to ``most`` characters, one of those that begin with the same ``same`` characters: that of the smallest id."""
    kept = df.filter(F.length(text_col).between(least, most))
    return kept.groupBy(F.substring(text_col, 1, same).alias("_begin")).agg(F.min_by(F.struct(*df.columns), F.struct(id_col)).alias("r")).select("r.*")


def prompt_mix(pools: dict[str, DataFrame], n: int, seed: int, col: str = "prompt") -> DataFrame:
    """``n`` prompts of every pool by a seeded order, with the pool's name; equal prompts of a pool count once."""
    parts = [df.select(F.col(col).alias("prompt")).filter("prompt is not null").distinct().orderBy(hashed(seed, F.col("prompt"))).limit(n).withColumn("pool", F.lit(name)) for name, df in sorted(pools.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_grid(spark: SparkSession, topics: DataFrame, runs: int, start: int = 42, step: int = 7) -> DataFrame:
    """Every topic with the seeds ``start``, ``start + step``, ...: an array per topic, exploded where it lies."""
    return topics.withColumn("seed", F.explode(F.array(*[F.lit(start + step * k) for k in range(runs)])))


def token_letters(tokens: DataFrame) -> DataFrame:
    """``letter``, ``n_tokens``, ``longest``: inverted index from the letters of a vocabulary to its tokens."""
    t = tokens.select("token_id", "token_text", F.explode(F.array_distinct(F.filter(F.split("token_text", ""), lambda c: c != ""))).alias("letter"))
    return t.groupBy("letter").agg(F.countDistinct("token_id").alias("n_tokens"), F.max(F.length("token_text")).alias("longest"))


def uncovered(letters: DataFrame, tokens: DataFrame) -> DataFrame:
    """Letters that no token has."""
    return letters.select("letter").distinct().join(token_letters(tokens).select("letter"), "letter", "left_anti")


def side_by_side(base: DataFrame, tuned: DataFrame, id_col: str, col: str) -> DataFrame:
    """Outputs of two models by id; N/A where the second has none."""
    return base.select(id_col, F.col(col).alias("base")).join(tuned.select(id_col, F.col(col).alias("tuned")), id_col, "left").withColumn("tuned", F.coalesce("tuned", F.lit("N/A")))


def without_metadata(df: DataFrame) -> DataFrame:
    """Columns whose names do not begin with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def crosscheck(df: DataFrame, expected: Column, got: Column) -> DataFrame:
    """Confusion counts of two verdicts."""
    return df.groupBy(expected.alias("expected"), got.alias("got")).agg(F.count(F.lit(1)).alias("n"))
