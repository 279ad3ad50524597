"""Queries on letters, profiles and verdict variants, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import letters as L
from ..functions import prosody as P
from ..functions.names import clean_source
from ..operators import metre, tilings
from ..scratch import table
from .verse import _BASE, _DOUBLE, _SYL_ROWS, CLEAN_SOURCE_SQL, POEMS, RAGALE_SQL, analysis_sql, lines_sql


def articulation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of the poems by the place of articulation of their first consonant."""
    s = table(spark, sf_dir, POEMS).select(F.explode(P.pure(P.syllables(F.col("poem")))).alias("x"))
    return s.groupBy(F.coalesce(L.articulation(P.base_consonant(F.col("x"))), F.lit("none")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def dominant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent syllable properties of the poems."""
    s = table(spark, sf_dir, POEMS).select(F.explode(P.pure(P.syllables(F.col("poem")))).alias("x")).select(F.explode(L.tags(F.col("x"))).alias("tag"))
    return s.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(3)


def rhyme_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metre.with_syllables(metre.with_lines(table(spark, sf_dir, POEMS).select("poem"), "poem").filter("line2 is not null")).filter("size(syl1) >= 2 and size(syl2) >= 2")
    v = L.rhyme_verdict(F.get("syl1", F.lit(1)), F.get("syl2", F.lit(1)))
    return got.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def strict_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the analyser beside those of the automata, which need alliteration only when strict."""
    got = metre.analyse(table(spark, sf_dir, POEMS).select("poem"), "poem")
    feet = F.coalesce((F.col("feet1.valid") == 4) & (F.col("feet2.valid") == 4), F.lit(False)) & F.col("prasa")
    strict = feet & (F.col("yati1") != "no_match") & (F.col("yati2") != "no_match")
    return got.groupBy("is_valid", feet.alias("loose"), F.coalesce(strict, F.lit(False)).alias("strict")).agg(F.count(F.lit(1)).alias("n"))


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplets whose first line ends light and whose second begins with a cluster."""
    two = metre.with_lines(table(spark, sf_dir, POEMS).select("poem"), "poem").filter("line2 is not null")
    return two.groupBy(L.begins_with_cluster(F.col("line2")).alias("cluster_second"), F.endswith("line1", F.lit("ు")).alias("first_in_u")).agg(F.count(F.lit(1)).alias("n"))


def poem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, sentences and paragraphs of every meaning text."""
    return table(spark, sf_dir, POEMS).filter("telugu_meaning is not null").select("rec_id", L.text_counts(F.col("telugu_meaning")).alias("c")).select("rec_id", *[F.col(f"c.{k}").cast("bigint").alias(k) for k in ("characters", "telugu", "words", "sentences", "paragraphs")])


def foot_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of divisions of the lines of the couplets into feet of the general metres (50 are listed at most)."""
    two = metre.with_syllables(metre.with_lines(table(spark, sf_dir, POEMS).select("rec_id", "poem"), "poem").filter("line2 is not null"))
    lines = two.select(F.explode(F.array("gana1", "gana2")).alias("gana")).groupBy("gana").agg(F.count(F.lit(1)).alias("n_lines"))
    return lines.select("gana", F.size(tilings.all_divisions(F.col("gana"))).cast("bigint").alias("n_divisions"), "n_lines")


def combined_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and synthetic records put together by name, with their work, by kind."""
    p = table(spark, sf_dir, POEMS).select("rec_id", clean_source(F.col("source")).alias("work"), "is_synthetic_data")
    real = p.filter("coalesce(is_synthetic_data, false) = false").select("rec_id", "work", F.lit("real").alias("kind"))
    made = p.filter("is_synthetic_data").select(F.lit("made").alias("kind"), "work", "rec_id")
    return real.unionByName(made).groupBy("kind", "work").agg(F.count(F.lit(1)).alias("n"))


def ragale_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kannada couplets by the verdict of the automaton on both lines."""
    from .verse import ragale_scores

    r = ragale_scores(table(spark, sf_dir, POEMS).select("rec_id", "poem"))
    return r.groupBy(L.ragale_valid(F.col("gana1")).alias("line1"), L.ragale_valid(F.col("gana2")).alias("line2"), "rhyme").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (articulation_counts, dominant_tags, rhyme_verdicts, strict_verdicts, line_shapes, poem_counts, foot_divisions, combined_corpus, ragale_verdicts)
}

_PLACE = "CASE " + " ".join(f"WHEN contains('{m}', {_BASE('x')}) THEN '{p}'" for p, m in A.ARTICULATION.items()) + " ELSE 'none' END"
_W = A.BLANKS
_PARTS = lambda x, sep: f"len(list_filter(regexp_split_to_array({x}, '{sep}'), lambda q: regexp_replace(q, '[{_W}]', '', 'g') <> ''))::BIGINT"

ORACLE_SQL: dict[str, str] = {
    "articulation_counts": f"SELECT {_PLACE} AS place, count(*) AS n FROM ({_SYL_ROWS}) GROUP BY 1",
    "rhyme_verdicts": f"WITH {analysis_sql()}, b AS (SELECT {_BASE('pure1[2]')} AS x, {_BASE('pure2[2]')} AS y FROM done WHERE len(pure1) >= 2 AND len(pure2) >= 2) SELECT CASE WHEN x IS NULL OR y IS NULL THEN 'no_consonant' WHEN x = y THEN 'exact' WHEN translate(x, '{A.RHYME_FROM}', '{A.RHYME_TO}') = translate(y, '{A.RHYME_FROM}', '{A.RHYME_TO}') THEN 'equivalent' ELSE 'mismatch' END AS verdict, count(*) AS n FROM b GROUP BY 1",
    "strict_verdicts": f"WITH {analysis_sql()}, v AS (SELECT is_valid, coalesce(valid1 = 4 AND valid2 = 4, false) AND rhyme AS loose, coalesce(yati1 <> 'no_match' AND yati2 <> 'no_match', false) AS y FROM scored) SELECT is_valid, loose, loose AND y AS strict, count(*) AS n FROM v GROUP BY ALL",
    "line_shapes": f"WITH {lines_sql()} SELECT regexp_matches(l2, '^[{A.CONSONANTS}]{A.VIRAMA}[{A.CONSONANTS}]') AS cluster_second, ends_with(l1, 'ు') AS first_in_u, count(*) AS n FROM two GROUP BY ALL",
    "poem_counts": f"SELECT rec_id, length(telugu_meaning)::BIGINT AS characters, length(regexp_replace(telugu_meaning, '[^\\x{{0C00}}-\\x{{0C7F}}]', '', 'g'))::BIGINT AS telugu, {_PARTS('telugu_meaning', f'[{_W}]+')} AS words, {_PARTS('telugu_meaning', '[.!?।॥]+')} AS sentences, {_PARTS('telugu_meaning', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} AS paragraphs FROM {POEMS} WHERE telugu_meaning IS NOT NULL",
    "combined_corpus": f"SELECT CASE WHEN is_synthetic_data THEN 'made' ELSE 'real' END AS kind, {CLEAN_SOURCE_SQL} AS work, count(*) AS n FROM {POEMS} GROUP BY 1, 2",
}

ORACLE_SQL["ragale_verdicts"] = f"WITH {RAGALE_SQL} SELECT regexp_matches(gana1, '^(II[IU]){{3}}IIU$') AS line1, regexp_matches(gana2, '^(II[IU]){{3}}IIU$') AS line2, rhyme, count(*) AS n FROM kr GROUP BY ALL"

_TAGS = {
    "double": _DOUBLE,
    "consonant": f"regexp_matches(x, '^[{A.CONSONANTS}]')",
    "cluster": f"regexp_matches(x, '[{A.CONSONANTS}]{A.VIRAMA}[{A.CONSONANTS}]') AND NOT {_DOUBLE}",
    "diphthong": f"regexp_matches(x, '[{A.DIPHTHONGS}]')",
    "final": f"ends_with(x, '{A.VIRAMA}')",
    "long": f"regexp_matches(x, '[{A.LONG_SIGNS}]|^[{A.LONG_VOWELS}]$')",
    "nasal": "contains(x, 'ం')",
    "breath": "contains(x, 'ః')",
    "vowel": f"regexp_matches(x, '^[{A.VOWELS}]')",
}
ORACLE_SQL["dominant_tags"] = f"WITH s AS ({_SYL_ROWS}) SELECT tag, n FROM ({' UNION ALL '.join(f'SELECT {t!r} AS tag, count(*) FILTER ({c}) AS n FROM s' for t, c in _TAGS.items())}) ORDER BY n DESC, tag LIMIT 3"
# counts of divisions from the end of a line backwards: the list holds those of every later place
_WAYS = " + ".join(f"CASE WHEN substring(gana, length(gana) - len(acc) + 1, {len(f)}) = '{f}' THEN coalesce(acc[{len(f)}], 0) ELSE 0 END" for f in tilings.GENERAL)
ORACLE_SQL["foot_divisions"] = f"WITH {analysis_sql()}, g AS (SELECT gana, count(*) AS n_lines FROM (SELECT unnest([gana1, gana2]) AS gana FROM done) GROUP BY 1) SELECT gana, CASE WHEN gana = '' THEN 0 ELSE least(50, list_reduce(list_concat([[1::BIGINT]], list_transform(range(length(gana)), lambda k: [k])), lambda acc, e: list_prepend(({_WAYS})::BIGINT, acc))[1])::BIGINT END AS n_divisions, n_lines FROM g"
