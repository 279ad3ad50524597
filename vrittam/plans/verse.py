"""Queries on the metre of couplets, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import prosody as P
from ..functions.names import clean_source
from ..operators import metre
from ..scratch import table
from ..streaming.streams import alive_counts, read_lines

POEMS = "dwipada_augmented_dataset"


def _poems(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, POEMS).select("rec_id", "poem", *cols)


def couplet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, rhyme, alliteration, score and verdict of every couplet record."""
    return metre.analyse(_poems(spark, sf_dir), "poem").select("rec_id", "gana1", "gana2", F.col("prasa").alias("rhyme"), "yati1", "yati2", "overall", "is_valid")


def source_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, perfect and valid couplets per source and over all (source null)."""
    got = metre.analyse(_poems(spark, sf_dir, "source"), "poem").withColumn("work", clean_source(F.col("source")))
    n = got.rollup("work").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("overall") == 100.0).alias("perfect"), F.count_if("is_valid").alias("valid"), F.grouping("work").cast("int").alias("is_total"))
    return n.withColumn("perfect_pct", F.round(F.col("perfect") * 100.0 / F.col("total"), 4))


def weight_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of both lines in the scope of the word and of the line."""
    two = metre.with_lines(_poems(spark, sf_dir), "poem").filter("line2 is not null").select("rec_id", F.posexplode(F.array("line1", "line2")).alias("k", "line"))
    two = two.withColumn("s", P.syllables(F.col("line")))
    return two.select("rec_id", (F.col("k") + 1).alias("k"), P.weights(F.col("s"), "word").alias("by_word"), P.weights(F.col("s"), "line").alias("by_line"), F.size(P.pure(F.col("s"))).cast("bigint").alias("n_syllables"))


def variant_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the two scopes agree, and whether a valid line comes out under each."""
    w = weight_strings(spark, sf_dir)
    t = F.broadcast(metre.line_table(spark).select(F.col("pattern")))
    w = w.join(t.select(F.col("pattern").alias("by_word"), F.lit(True).alias("v1")), "by_word", "left").join(t.select(F.col("pattern").alias("by_line"), F.lit(True).alias("v2")), "by_line", "left")
    return w.groupBy((F.col("by_word") == F.col("by_line")).alias("agree"), F.coalesce("v1", F.lit(False)).alias("valid_by_word"), F.coalesce("v2", F.lit(False)).alias("valid_by_line")).agg(F.count(F.lit(1)).alias("n"))


def syllable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every syllable of the poems."""
    s = _poems(spark, sf_dir).filter("poem is not null").select("rec_id", F.explode(P.pure(P.syllables(F.col("poem")))).alias("syllable"))
    return s.groupBy("syllable").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec_id").alias("n_records"))


def syllable_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syllable_counts(spark, sf_dir).select("syllable", "n").orderBy(F.desc("n"), "syllable").limit(25)


def syllable_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables by their properties: vowel, long, nasal, breath, cluster, doubled consonant."""
    s = _poems(spark, sf_dir).filter("poem is not null").select(F.explode(P.pure(P.syllables(F.col("poem")))).alias("x"))
    x = F.col("x")
    double = F.regexp_extract(x, f"([{A.CONSONANTS}]){A.VIRAMA}\\1", 0) != ""
    tags = F.array_compact(
        F.array(
            F.when(F.substring(x, 1, 1).isin(*A.VOWELS), "vowel"),
            F.when(F.substring(x, 1, 1).isin(*A.CONSONANTS), "consonant"),
            F.when(x.rlike(f"[{A.LONG_SIGNS}]|^[{A.LONG_VOWELS}]$"), "long"),
            F.when(F.contains(x, F.lit("ం")), "nasal"),
            F.when(F.contains(x, F.lit("ః")), "breath"),
            F.when(x.rlike(P.CLUSTER) & ~double, "cluster"),
            F.when(double, "double"),
        )
    )
    return s.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def foot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feet of the valid lines by place, parsed by a join with the table of valid lines."""
    two = metre.with_syllables(metre.with_lines(_poems(spark, sf_dir), "poem").filter("line2 is not null"))
    g = two.select(F.explode(F.array("gana1", "gana2")).alias("pattern"))
    parsed = g.join(F.broadcast(metre.line_table(spark)), "pattern")
    return parsed.select(F.posexplode(F.array("foot1", "foot2", "foot3", "foot4")).alias("place", "foot")).groupBy((F.col("place") + 1).alias("place"), "foot").agg(F.count(F.lit(1)).alias("n"))


def rhyme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhyme consonants of the two lines as unordered pairs, and how often each rhymes."""
    got = metre.with_syllables(metre.with_lines(_poems(spark, sf_dir), "poem").filter("line2 is not null"))
    a, b = (F.coalesce(P.base_consonant(F.get(F.col(f"syl{k}"), F.lit(1))), F.lit("-")) for k in "12")
    return got.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"), F.coalesce(P.rhymes(F.col("syl1"), F.col("syl2")), F.lit(False)).alias("rhyme")).groupBy("first", "second", "rhyme").agg(F.count(F.lit(1)).alias("n"))


def alliteration_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the kind of their alliteration and line number."""
    got = metre.analyse(_poems(spark, sf_dir), "poem")
    both = got.select(F.posexplode(F.array(F.coalesce("yati1", F.lit("none")), F.coalesce("yati2", F.lit("none")))).alias("line", "kind"))
    return both.groupBy((F.col("line") + 1).alias("line"), "kind").agg(F.count(F.lit(1)).alias("n"))


def level1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metre level: analysed records, errors (fewer than two lines), averages and pass rates; errors are not averaged."""
    got = metre.analysed(_poems(spark, sf_dir), "poem")
    fine = F.col("error").isNull()
    return got.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(fine).alias("n_analysed"),
        F.round(F.avg("overall"), 6).alias("avg_overall"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if("prasa").alias("n_rhyme"),
        F.count_if(fine & (F.col("feet1.valid") == 4) & (F.col("feet2.valid") == 4)).alias("n_feet"),
        F.count_if(fine & (F.coalesce("yati1", F.lit("x")) != "no_match") & (F.coalesce("yati2", F.lit("x")) != "no_match")).alias("n_yati"),
        F.count_if(~fine).alias("n_errors"),
    )


def metre_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feet of both lines of a record as text: syllables, name, weights and kind of each; null without feet."""
    got = metre.analyse(_poems(spark, sf_dir), "poem")
    made = []
    for n in "12":
        feet, gana = f"feet{n}", F.col(f"gana{n}")
        at = [F.lit(1), F.col(f"{feet}.a") + 1, F.col(f"{feet}.a") + F.col(f"{feet}.b") + 1, F.col(f"{feet}.a") + F.col(f"{feet}.b") + F.col(f"{feet}.c") + 1]
        names = metre.foot_names(feet, f"gana{n}")
        parts = []
        for i, (p, k) in enumerate(zip(at, "abcd")):
            w = F.substring(gana, p, F.col(f"{feet}.{k}"))
            kind = F.when(w.isin(*A.INDRA), "Indra").when(w.isin(*A.SURYA), "Surya").otherwise("unknown")
            parts.append(F.concat(F.array_join(F.slice(f"syl{n}", p, F.col(f"{feet}.{k}")), ""), F.lit(" ("), F.coalesce(F.get(names, F.lit(i)), F.lit("unknown")), F.lit(" - "), w, F.lit(" - "), kind, F.lit(")")))
        made.append(F.when(F.col(feet).isNotNull(), F.concat_ws(" | ", *parts)).alias(f"breakdown{n}"))
    return got.select("rec_id", *made)


def kannada_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of Kannada couplets in the ragale metre: syllables, feet, heavy ending, rhyme.

    Syllable weights cross words; a foot may be any of three at each place; ties of the rounded
    score go to the even digit.
    """
    return ragale_scores(table(spark, sf_dir, POEMS).select("rec_id", "poem"))


def ragale_scores(df: DataFrame) -> DataFrame:
    """``rec_id`` and ragale score columns of the Kannada poems in ``df``."""
    kn = metre.with_lines(df, "poem").filter(F.col("line2").isNotNull() & F.col("line1").rlike(r"[\x{0C80}-\x{0CFF}]"))
    to_te = "".join(chr(0xC80 + k) for k in range(0x80)), "".join(chr(0xC00 + k) for k in range(0x80))
    for k in "12":
        # the Kannada block is laid out like the Telugu one; letters of other scripts are dropped
        kn = kn.withColumn(f"line{k}", F.regexp_replace(F.translate(F.regexp_replace(f"line{k}", r"[^\x{0C80}-\x{0CFF}]", ""), *to_te), f"[^{A.CONSONANTS}{A.VOWELS}{A.SIGNS}{A.DIACRITICS}{A.VIRAMA}]", ""))
    kn = metre.with_syllables(kn, "line")
    feet = ", ".join(repr(f) for f in A.RAGALE)
    for k in "12":
        g = f"gana{k}"
        combos = ", ".join(f"named_struct('a', {a}, 'b', {b}, 'c', {c}, 'd', {d})" for a in (2, 3) for b in (2, 3) for c in (2, 3) for d in (2, 3))
        cut = [f"substring({g}, 1, x.a)", f"substring({g}, 1 + x.a, x.b)", f"substring({g}, 1 + x.a + x.b, x.c)", f"substring({g}, 1 + x.a + x.b + x.c, x.d)"]
        best = f"array_max(transform(filter(array({combos}), x -> x.a + x.b + x.c + x.d = length({g})), x -> {' + '.join(f'int({c} IN ({feet}))' for c in cut)}))"
        greedy = f"size(filter(transform(sequence(0, greatest((length({g}) - 1) div 3, 0)), i -> substring({g}, 1 + i * 3, 3)), f -> f IN ({feet})))"
        kn = kn.withColumn(f"feet{k}", F.expr(f"least(coalesce({best}, {greedy}), 4)"))
    n = [F.length(f"gana{k}") for k in "12"]
    syl = sum((F.greatest(F.lit(0.0), 100 - F.abs(x - 12) * 20.0) for x in n), F.lit(0.0)) / 2
    gana = (F.when(n[0] == 0, 0.0).otherwise(F.col("feet1") * 25.0) + F.when(n[1] == 0, 0.0).otherwise(F.col("feet2") * 25.0)) / 2
    guru = (F.endswith(F.col("gana1"), F.lit("U")).cast("int") + F.endswith(F.col("gana2"), F.lit("U")).cast("int")) * 50.0
    second = [P.base_consonant(F.get(F.col(f"syl{k}"), F.lit(1))) for k in "12"]
    rhyme = F.coalesce(second[0] == second[1], F.lit(False))
    score = syl * 0.20 + gana * 0.30 + guru * 0.15 + F.when(rhyme, 100.0).otherwise(0.0) * 0.35
    return kn.select("rec_id", n[0].cast("bigint").alias("n1"), n[1].cast("bigint").alias("n2"), "gana1", "gana2", rhyme.alias("rhyme"), F.bround(score, 1).alias("score"))


def couplet_line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines of the metre, with how many feet begin them in common: the table that parses are joined with."""
    return metre.line_table(spark)


def line_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of valid lines, the weights that may follow, and the least number still needed."""
    return metre.prefix_table(spark)


def reader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplets for which the incremental reader, fed both lines, and the column expressions give the same weights and verdict, and others; a line without syllables is none to the reader."""
    two = metre.with_syllables(metre.with_lines(_poems(spark, sf_dir), "poem").filter("line2 is not null"))
    t = F.broadcast(metre.line_table(spark).select("pattern"))
    flag = lambda k: t.select(F.col("pattern").alias(f"gana{k}"), F.lit(True).alias(f"ok{k}"))
    want = two.select("rec_id", "line1", "line2", "gana1", "gana2").join(flag(1), "gana1", "left").join(flag(2), "gana2", "left")
    want = want.select("rec_id", F.concat_ws("|", *[F.nullif(F.col(g), F.lit("")) for g in ("gana1", "gana2")]).alias("pattern"), F.coalesce(F.col("ok1") & F.col("ok2"), F.lit(False)).alias("by_table"))
    got = read_lines(two.select("rec_id", F.concat_ws("\n", "line1", "line2").alias("text")), "rec_id", "text").select(F.col("id").alias("rec_id"), "weights", F.col("all_valid").alias("by_reader"))
    return want.join(got, "rec_id").groupBy((F.col("pattern") == F.col("weights")).alias("same_weights"), "by_table", "by_reader").agg(F.count(F.lit(1)).alias("n"))


def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Living tokens after every first word of the poems: the words of the glosses stand for the vocabulary."""
    words = table(spark, sf_dir, POEMS).select(F.explode(F.map_keys("word_to_word_meaning")).alias("token_text")).filter("token_text is not null").distinct()
    start = _poems(spark, sf_dir).filter("poem is not null").select(F.regexp_extract("poem", f"[^{A.BLANKS}]+", 0).alias("prefix")).filter("prefix <> ''").distinct()
    return alive_counts(start, words)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (couplet_scores, source_purity, weight_strings, variant_confusion, syllable_counts, syllable_top25, syllable_tags, foot_usage, rhyme_pairs, alliteration_kinds, level1_rates, metre_strings, couplet_line_patterns, line_prefixes, reader_agreement, token_candidates)
} | {"ragale_scores": kannada_weights}

# -- SQL -------------------------------------------------------------------------------------------

_H, _C, _V, _M, _D, _S = A.VIRAMA, A.CONSONANTS, A.VOWELS, A.SIGNS, A.DIACRITICS, A.SEPARATOR_CLASS
_SEP_LIST = ", ".join("chr(10)" if s == "\n" else f"chr({ord(s)})" for s in A.SEPARATORS)
_X = "\x01"  # stands for a final virama, as the expressions of DuckDB cannot look ahead


def _syllables_sql(line: str) -> str:
    marked = f"regexp_replace(regexp_replace({line}, '([{_C}]){_H}([^{_C}{_M}{_D}])', '\\1{_X}\\2', 'g'), '([{_C}]){_H}$', '\\1{_X}', 'g')"
    found = f"regexp_extract_all({marked}, '(?:[{_C}](?:{_H}[{_C}])*(?:{_H}|{_X})?[{_M}{_D}]*|[{_V}][{_D}]?|[^{_S}])(?:[{_C}]{_X})?|[{_S}]')"
    return f"list_transform({found}, lambda s: replace(s, '{_X}', '{_H}'))"


def _weights_sql(syl: str, space: bool) -> str:
    keep = f"list_filter({syl}, lambda x: {'x = chr(32) OR ' if space else ''}NOT list_contains([{_SEP_LIST}], x))"
    heavy = f"regexp_matches(x, '[{A.LONG_SIGNS}{A.DIPHTHONGS}{_D}]|^[{A.LONG_VOWELS}]$|{_H}$')"
    return f"array_to_string(list_transform({keep}, lambda x, i: CASE WHEN x = chr(32) THEN '' WHEN {heavy} OR coalesce(regexp_matches(({keep})[i + 1], '[{_C}]{_H}[{_C}]'), false) THEN 'U' ELSE 'I' END), '')"


def lines_sql(cols: str = "") -> str:
    """CTE ``two``: rec_id, l1, l2 of every poem with two lines."""
    return f"""
raw AS (SELECT rec_id, {cols} list_filter(list_transform(string_split(poem, chr(10)), lambda l: regexp_replace(l, '^[{A.BLANKS}]+|[{A.BLANKS}]+$', '', 'g')), lambda l: l <> '') AS ls FROM {POEMS} WHERE poem IS NOT NULL),
two AS (SELECT rec_id, {cols} ls[1] AS l1, ls[2] AS l2 FROM raw WHERE len(ls) >= 2)"""


def _letter_class(x: str, groups: tuple[str, ...]) -> str:
    return f"translate({x}, '{''.join(groups)}', '{''.join(chr(97 + k) * len(g) for k, g in enumerate(groups))}')"


_COMBOS = ", ".join(f"({k}, {a}, {b}, {c}, {d}, {a + b + c + d})" for k, (a, b, c, d) in enumerate(A.LENGTHS))
_CUTS = ["substring(gana, 1, a)", "substring(gana, 1 + a, b)", "substring(gana, 1 + a + b, c)", "substring(gana, 1 + a + b + c, d)"]
_IN = lambda p, x: f"({x} IN ({', '.join(repr(q) for q in p)}))::INT"
_VOWEL = lambda s: f"(CASE WHEN regexp_matches({s}, '[{_M}]') THEN translate(regexp_extract({s}, '[{_M}]'), '{_M}', '{A.SIGN_VOWELS}') WHEN regexp_matches({s}, '^[{_V}]') THEN left({s}, 1) ELSE 'అ' END)"
_BASE = lambda s: f"nullif(regexp_extract({s}, '^[{_C}]'), '')"
_NASALS = "".join(A.NASALS), "".join(n * len(g) for g, n in A.NASALS.items())
_BINDU = lambda x, y: f"coalesce(contains({x}, 'ం') AND contains('{_NASALS[0]}', {_BASE(x)}) AND translate({_BASE(x)}, '{_NASALS[0]}', '{_NASALS[1]}') = {_BASE(y)}, false)"


def analysis_sql(cols: str = "") -> str:
    """CTE ``done``: one row per couplet with the columns of :func:`couplet_scores` and the feet."""
    return f"""{lines_sql(cols)},
lng AS (SELECT rec_id, 1 AS k, {_syllables_sql("l1")} AS sy FROM two UNION ALL SELECT rec_id, 2 AS k, {_syllables_sql("l2")} AS sy FROM two),
wts AS (SELECT rec_id, k, sy, list_filter(sy, lambda x: NOT list_contains([{_SEP_LIST}], x)) AS pure, {_weights_sql("sy", True)} AS gana FROM lng),
combos(o, a, b, c, d, n) AS (VALUES {_COMBOS}),
tried AS (SELECT rec_id, k, o, a, b, c, d, {" + ".join(_IN(A.SURYA if i == 3 else A.INDRA, x) for i, x in enumerate(_CUTS))} AS valid, {" + ".join(_IN([*A.INDRA, *A.SURYA], x) for x in _CUTS)} AS named FROM wts JOIN combos ON n = length(gana)),
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY rec_id, k ORDER BY valid DESC, o) = 1),
feet AS (SELECT w.rec_id, w.k, w.gana, w.pure, b.valid, b.named, b.a, b.b, b.c, b.d, w.pure[1] AS x, w.pure[b.a + b.b + 1] AS y FROM wts w LEFT JOIN best b USING (rec_id, k)),
kinds AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN left(x, 1) = left(y, 1) THEN 'exact'
  WHEN {_letter_class("left(x, 1)", A.ALLITERATION)} = {_letter_class("left(y, 1)", A.ALLITERATION)} THEN 'varga_match'
  WHEN {_letter_class(_VOWEL("x"), A.VOWEL_FAMILIES)} = {_letter_class(_VOWEL("y"), A.VOWEL_FAMILIES)} THEN 'svara_yati'
  WHEN list_has_any(list_transform(regexp_extract_all(x, '[{_C}]'), lambda q: {_letter_class("q", A.ALLITERATION)}), list_transform(regexp_extract_all(y, '[{_C}]'), lambda q: {_letter_class("q", A.ALLITERATION)})) THEN 'samyukta_yati'
  WHEN {_BINDU("x", "y")} OR {_BINDU("y", "x")} THEN 'bindu_yati' ELSE 'no_match' END AS yati FROM feet),
done AS (SELECT p.rec_id, {", ".join(f"t.{c.strip()}" for c in cols.split(",") if c.strip()) + "," if cols else ""} p.gana AS gana1, q.gana AS gana2, p.valid AS valid1, q.valid AS valid2, p.yati AS yati1, q.yati AS yati2, p.pure AS pure1, q.pure AS pure2, p.a, p.b, p.c, p.d,
  coalesce(len(p.pure) >= 2 AND len(q.pure) >= 2 AND translate({_BASE("p.pure[2]")}, '{A.RHYME_FROM}', '{A.RHYME_TO}') = translate({_BASE("q.pure[2]")}, '{A.RHYME_FROM}', '{A.RHYME_TO}'), false) AS rhyme,
  (coalesce(p.named, 0) + coalesce(q.named, 0)) * 12.5 * 0.40 AS feet_part, ((coalesce(p.yati, 'no_match') <> 'no_match')::INT + (coalesce(q.yati, 'no_match') <> 'no_match')::INT) * 50.0 * 0.25 AS yati_part
  FROM (SELECT * FROM kinds WHERE k = 1) p JOIN (SELECT * FROM kinds WHERE k = 2) q USING (rec_id) JOIN two t USING (rec_id)),
scored AS (SELECT *, round((feet_part + rhyme::INT * 35.0 + yati_part)::DOUBLE, 1) AS overall,
  coalesce(valid1 = 4, false) AND coalesce(valid2 = 4, false) AND rhyme AND coalesce(yati1 <> 'no_match', true) AND coalesce(yati2 <> 'no_match', true) AS is_valid FROM done)"""


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(lower(source), '^[\s\x{a0}\x{2000}-\x{200b}/]+|[\s\x{a0}\x{2000}-\x{200b}/]+$', '', 'g'), '\.(txt|json|jsonl)$', ''), '/.*$', '')"
CLEAN_SOURCE_SQL = rf"coalesce(nullif(regexp_replace({_CLEAN}, '[\s\x{{a0}}_-]+', '_', 'g'), ''), 'unknown')"

_TABLE_SQL = f"(SELECT x.p || y.p || z.p || w.p AS pattern, x.p AS foot1, y.p AS foot2, z.p AS foot3, w.p AS foot4, (length(x.p) + length(y.p) + 1)::INT AS third_at FROM (VALUES {', '.join(f'({p!r})' for p in A.INDRA)}) x(p), (VALUES {', '.join(f'({p!r})' for p in A.INDRA)}) y(p), (VALUES {', '.join(f'({p!r})' for p in A.INDRA)}) z(p), (VALUES {', '.join(f'({p!r})' for p in A.SURYA)}) w(p))"

_SYL_ROWS = f"SELECT rec_id, unnest(list_filter({_syllables_sql('poem')}, lambda x: NOT list_contains([{_SEP_LIST}], x))) AS x FROM {POEMS} WHERE poem IS NOT NULL"
_DOUBLE = "(" + " OR ".join(f"contains(x, '{c}{_H}{c}')" for c in _C) + ")"

ORACLE_SQL: dict[str, str] = {
    "couplet_scores": f"WITH {analysis_sql()} SELECT rec_id, gana1, gana2, rhyme, yati1, yati2, overall, is_valid FROM scored",
    "source_purity": f"WITH {analysis_sql('source,')} SELECT {CLEAN_SOURCE_SQL} AS work, count(*) AS total, count(*) FILTER (overall = 100.0) AS perfect, count(*) FILTER (is_valid) AS valid, 0::INT AS is_total, round(count(*) FILTER (overall = 100.0) * 100.0 / count(*), 4)::DOUBLE AS perfect_pct FROM scored GROUP BY 1 UNION ALL SELECT NULL, count(*), count(*) FILTER (overall = 100.0), count(*) FILTER (is_valid), 1::INT, round(count(*) FILTER (overall = 100.0) * 100.0 / count(*), 4)::DOUBLE FROM scored",
    "weight_strings": f"WITH {lines_sql()}, s AS (SELECT rec_id, 1 AS k, {_syllables_sql('l1')} AS sy FROM two UNION ALL SELECT rec_id, 2, {_syllables_sql('l2')} FROM two) SELECT rec_id, k, {_weights_sql('sy', True)} AS by_word, {_weights_sql('sy', False)} AS by_line, len(list_filter(sy, lambda x: NOT list_contains([{_SEP_LIST}], x)))::BIGINT AS n_syllables FROM s",
    "variant_confusion": f"WITH {lines_sql()}, s AS (SELECT rec_id, {_syllables_sql('l1')} AS sy FROM two UNION ALL SELECT rec_id, {_syllables_sql('l2')} FROM two), w AS (SELECT {_weights_sql('sy', True)} AS a, {_weights_sql('sy', False)} AS b FROM s), t AS (SELECT pattern FROM {_TABLE_SQL}) SELECT a = b AS agree, a IN (SELECT pattern FROM t) AS valid_by_word, b IN (SELECT pattern FROM t) AS valid_by_line, count(*) AS n FROM w GROUP BY ALL",
    "syllable_counts": f"SELECT x AS syllable, count(*) AS n, count(DISTINCT rec_id) AS n_records FROM ({_SYL_ROWS}) GROUP BY x",
    "syllable_top25": f"SELECT x AS syllable, count(*) AS n FROM ({_SYL_ROWS}) GROUP BY x ORDER BY n DESC, x LIMIT 25",
    "syllable_tags": f"SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(x, '^[{_V}]') THEN 'vowel' END, CASE WHEN regexp_matches(x, '^[{_C}]') THEN 'consonant' END, CASE WHEN regexp_matches(x, '[{A.LONG_SIGNS}]|^[{A.LONG_VOWELS}]$') THEN 'long' END, CASE WHEN contains(x, 'ం') THEN 'nasal' END, CASE WHEN contains(x, 'ః') THEN 'breath' END, CASE WHEN regexp_matches(x, '[{_C}]{_H}[{_C}]') AND NOT {_DOUBLE} THEN 'cluster' END, CASE WHEN {_DOUBLE} THEN 'double' END], lambda t: t IS NOT NULL)) AS tag FROM ({_SYL_ROWS})) GROUP BY tag",
    "foot_usage": f"WITH {analysis_sql()}, g AS (SELECT gana1 AS pattern FROM done UNION ALL SELECT gana2 FROM done), j AS (SELECT t.* FROM g JOIN {_TABLE_SQL} t USING (pattern)) SELECT place::INT AS place, foot, count(*) AS n FROM (SELECT 1 AS place, foot1 AS foot FROM j UNION ALL SELECT 2, foot2 FROM j UNION ALL SELECT 3, foot3 FROM j UNION ALL SELECT 4, foot4 FROM j) GROUP BY ALL",
    "rhyme_pairs": f"WITH {analysis_sql()}, r AS (SELECT coalesce({_BASE('pure1[2]')}, '-') AS a, coalesce({_BASE('pure2[2]')}, '-') AS b, rhyme FROM done) SELECT least(a, b) AS first, greatest(a, b) AS second, rhyme, count(*) AS n FROM r GROUP BY ALL",
    "alliteration_kinds": f"WITH {analysis_sql()} SELECT line::INT AS line, kind, count(*) AS n FROM (SELECT 1 AS line, coalesce(yati1, 'none') AS kind FROM done UNION ALL SELECT 2, coalesce(yati2, 'none') FROM done) GROUP BY ALL",
    "level1_rates": f"WITH {analysis_sql()} SELECT (SELECT count(*) FROM {POEMS}) AS n_records, count(*) AS n_analysed, round(avg(overall), 6) AS avg_overall, count(*) FILTER (is_valid) AS n_valid, count(*) FILTER (rhyme) AS n_rhyme, count(*) FILTER (valid1 = 4 AND valid2 = 4) AS n_feet, count(*) FILTER (coalesce(yati1, 'x') <> 'no_match' AND coalesce(yati2, 'x') <> 'no_match') AS n_yati, (SELECT count(*) FROM {POEMS}) - count(*) AS n_errors FROM scored",
    "couplet_line_patterns": f"SELECT * FROM {_TABLE_SQL}",
}
_NAME = "CASE {} " + " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in {**A.INDRA, **A.SURYA}.items()) + " ELSE 'unknown' END"


def _part(start: str, size: str) -> str:
    cut = f"substring(gana, {start}, {size})"
    kind = f"CASE WHEN {cut} IN ({', '.join(repr(p) for p in A.INDRA)}) THEN 'Indra' WHEN {cut} IN ({', '.join(repr(p) for p in A.SURYA)}) THEN 'Surya' ELSE 'unknown' END"
    return f"array_to_string(list_slice(pure, {start}, {start} + {size} - 1), '') || ' (' || {_NAME.format(cut)} || ' - ' || {cut} || ' - ' || {kind} || ')'"


ORACLE_SQL["reader_agreement"] = f"WITH {analysis_sql()}, v AS (SELECT gana1, gana2, gana1 IN (SELECT pattern FROM {_TABLE_SQL}) AS ok1, gana2 IN (SELECT pattern FROM {_TABLE_SQL}) AS ok2 FROM done) SELECT true AS same_weights, ok1 AND ok2 AS by_table, (ok1 OR gana1 = '') AND (ok2 OR gana2 = '') AND gana1 || gana2 <> '' AS by_reader, count(*) AS n FROM v GROUP BY ALL"
_BREAKDOWN = f"CASE WHEN a IS NOT NULL THEN {_part('1', 'a')} || ' | ' || {_part('(1 + a)', 'b')} || ' | ' || {_part('(1 + a + b)', 'c')} || ' | ' || {_part('(1 + a + b + c)', 'd')} END"
ORACLE_SQL["metre_strings"] = f"WITH {analysis_sql()}, m AS (SELECT rec_id, k, {_BREAKDOWN} AS t FROM kinds) SELECT rec_id, max(t) FILTER (k = 1) AS breakdown1, max(t) FILTER (k = 2) AS breakdown2 FROM m GROUP BY 1"

ORACLE_SQL["line_prefixes"] = f"WITH t AS (SELECT pattern FROM {_TABLE_SQL}), b AS (SELECT DISTINCT substring(pattern, 1, k) AS prefix FROM t, range(0, 16) r(k) WHERE k <= length(pattern)) SELECT prefix, (CASE WHEN prefix || 'I' IN (SELECT prefix FROM b) THEN 'I' ELSE '' END) || (CASE WHEN prefix || 'U' IN (SELECT prefix FROM b) THEN 'U' ELSE '' END) AS next, prefix IN (SELECT pattern FROM t) AS complete, (SELECT min(length(pattern)) FROM t WHERE starts_with(pattern, b.prefix))::INT - length(prefix)::INT AS least_to_end FROM b"

_TO_TE = "".join(chr(0xC80 + k) for k in range(0x80)), "".join(chr(0xC00 + k) for k in range(0x80))
_KN_LINE = lambda x: f"regexp_replace(translate(regexp_replace({x}, '[^\\x{{0C80}}-\\x{{0CFF}}]', '', 'g'), '{_TO_TE[0]}', '{_TO_TE[1]}'), '[^{_C}{_V}{_M}{_D}{_H}]', '', 'g')"
_KN_CUTS = ["substring(g, 1, a)", "substring(g, 1 + a, b)", "substring(g, 1 + a + b, c)", "substring(g, 1 + a + b + c, d)"]
_KN_COMBOS = ", ".join(f"({a}, {b}, {c}, {d}, {a + b + c + d})" for a in (2, 3) for b in (2, 3) for c in (2, 3) for d in (2, 3))
RAGALE_SQL = f"""{lines_sql()}, kn AS (SELECT rec_id, {_KN_LINE("l1")} AS k1, {_KN_LINE("l2")} AS k2 FROM two WHERE regexp_matches(l1, '[\\x{{0C80}}-\\x{{0CFF}}]')),
ks AS (SELECT rec_id, 1 AS k, {_syllables_sql("k1")} AS sy FROM kn UNION ALL SELECT rec_id, 2, {_syllables_sql("k2")} FROM kn), kw AS (SELECT rec_id, k, sy, {_weights_sql("sy", False)} AS g FROM ks),
kc(a, b, c, d, n) AS (VALUES {_KN_COMBOS}), kt AS (SELECT rec_id, k, max({" + ".join(_IN(A.RAGALE, x) for x in _KN_CUTS)}) AS best FROM kw JOIN kc ON n = length(g) GROUP BY 1, 2),
kf AS (SELECT kw.*, least(coalesce(best, len(list_filter(list_transform(range(0, greatest((length(g) + 2) // 3, 1)), lambda i: substring(g, 1 + i * 3, 3)), lambda f: f IN ({", ".join(repr(f) for f in A.RAGALE)})))), 4) AS feet FROM kw LEFT JOIN kt USING (rec_id, k)),
kr AS (SELECT p.rec_id, length(p.g)::BIGINT AS n1, length(q.g)::BIGINT AS n2, p.g AS gana1, q.g AS gana2, coalesce({_BASE("p.sy[2]")} = {_BASE("q.sy[2]")}, false) AS rhyme,
 (greatest(0, 100 - abs(length(p.g) - 12) * 20) + greatest(0, 100 - abs(length(q.g) - 12) * 20)) / 2.0::DOUBLE AS syl, ((CASE WHEN p.g = '' THEN 0 ELSE p.feet END) + (CASE WHEN q.g = '' THEN 0 ELSE q.feet END)) * 12.5::DOUBLE AS gana, (ends_with(p.g, 'U')::INT + ends_with(q.g, 'U')::INT) * 50.0::DOUBLE AS guru FROM (SELECT * FROM kf WHERE k = 1) p JOIN (SELECT * FROM kf WHERE k = 2) q USING (rec_id))"""
ORACLE_SQL["ragale_scores"] = f"WITH {RAGALE_SQL} SELECT rec_id, n1, n2, gana1, gana2, rhyme, round_even((syl * 0.20::DOUBLE + gana * 0.30::DOUBLE + guru * 0.15::DOUBLE + rhyme::INT * 100.0 * 0.35::DOUBLE)::DOUBLE, 1) AS score FROM kr"
