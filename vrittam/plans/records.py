"""Queries on records: what they can serve, instructions from them, analysis texts, filters with reasons, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import cleaning, extract, scripts
from ..functions import letters as L
from ..functions import prosody as P
from ..functions.names import clean_source
from ..operators import filters, instructions, lines, metre, profiles
from ..scratch import table
from ..sources import formats, pages
from ..streaming.streams import prefix_states
from .verse import _DOUBLE, _SYL_ROWS, CLEAN_SOURCE_SQL, POEMS, _syllables_sql, _weights_sql, analysis_sql, lines_sql

SEED = 11
DRAW_WEIGHTS = {"GN1": 0.2, "GN2": 0.16, "GN3": 0.1, "GN4": 0.12, "AN1": 0.14, "AN2": 0.14, "RT1": 0.07, "SP1": 0.06}
EXCLUDED = ["synthetic", "unknown"]


def _poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, POEMS)


def digest(text: Column) -> Column:
    """MD5 of a text; null stays null."""
    return F.md5(text)


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of records that pass each of the fifteen checks, and a verdict."""
    names = list(profiles.checks([]))
    one = profiles.offered(_poems(spark, sf_dir)).select(*[F.col(f"_has_{n}").alias(n) for n in names])
    return profiles.shares(one, names).select(F.col("name").alias("field"), "n", F.round("pct", 4).alias("pct"), profiles.coverage_verdict(F.col("pct")).alias("verdict"))


def profile_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can serve each of the 26 profiles, and a verdict."""
    got = profiles.shares(profiles.feasible(_poems(spark, sf_dir), "rec_id"), list(profiles.NEEDS))
    return got.select(F.col("name").alias("profile_id"), "n", F.round("pct", 4).alias("pct"), profiles.profile_verdict(F.col("pct")).alias("verdict"))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.draw(profiles.feasible(_poems(spark, sf_dir), "rec_id"), DRAW_WEIGHTS, 3, SEED)


def profile_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three profiles for every record, by weight without replacement."""
    return _draws(spark, sf_dir).select(F.col("id").alias("rec_id"), F.array_join("profiles", ",").alias("profiles"))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every drawn profile; a tenth of the records each is test (one profile) and validation."""
    u = profiles.uniform(5, F.col("id"))
    split = F.when(u < 0.1, "test").when(u < 0.2, "val").otherwise("train")
    return profiles.exploded(_draws(spark, sf_dir), split, "GN1").withColumnRenamed("id", "rec_id")


def tiered_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter gloss profile for 55 % of the records that can serve both, the other one else."""
    return profiles.tiered(_poems(spark, sf_dir), "rec_id", SEED).withColumnRenamed("id", "rec_id")


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction and answer of every record under one of four templates."""
    got = instructions.chat_records(_poems(spark, sf_dir), "rec_id", SEED)
    return got.select(F.col("id").alias("rec_id"), "profile_id", "source_tag", digest(F.col("instruction")).alias("instruction"), digest(F.col("output")).alias("output"))


def analysis_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gloss, analysis, foot patterns and foot names of every record as instructions quote them."""
    got = instructions.analysis_texts(_poems(spark, sf_dir), "rec_id")
    return got.select(F.col("id").alias("rec_id"), F.length("gloss").cast("bigint").alias("gloss_length"), digest(F.col("analysis")).alias("analysis"), "pattern", "names")


def corrupted_couplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplets with one wrong letter, for correction."""
    got = instructions.corrupted(_poems(spark, sf_dir), "rec_id")
    return got.select(F.col("id").alias("rec_id"), "kind", "letter", "wrong", digest(F.col("right")).alias("right"))


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cleaned with the settings of each source: lines, characters removed and the text's digest."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    parts = F.array(*[F.struct(F.lit(name).alias("setting"), cleaning.clean_text(F.col("text"), *given).alias("c")) for name, given in cleaning.SOURCES.items()])
    return d.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.setting", F.col("p.c.lines").cast("bigint").alias("lines"), F.col("p.c.removed").cast("bigint").alias("removed"), digest(F.col("p.c.text")).alias("text"))


def line_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document by zone."""
    z = lines.zones(table(spark, sf_dir, "documents"), "doc_id", "text")
    return z.groupBy(F.col("id").alias("doc_id"), "zone").agg(F.count(F.lit(1)).alias("n_lines"), F.min("no").cast("bigint").alias("first"))


def section_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the sections that are missing; null where none is."""
    got = filters.sections_reason(_poems(spark, sf_dir), "prompt", "poem", "telugu_meaning", "english_meaning")
    return got.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def score_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are no couplets of score 100, with the reason."""
    return filters.split_by_reason(filters.score_reason(_poems(spark, sf_dir).select("rec_id", "poem"), "poem"))[1].select("rec_id", "reason")


def couplet_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed and refused records, none left out, with the number of valid ones."""
    got = metre.analysed(_poems(spark, sf_dir).select("poem"), "poem")
    return got.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"), F.count("overall").alias("scored"))


def kept_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the sources that are not excluded."""
    got = filters.without(_poems(spark, sf_dir).select(clean_source(F.col("source")).alias("work")), F.col("work"), EXCLUDED)
    return got.groupBy("work").agg(F.count(F.lit(1)).alias("n"))


def trained_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records but for the test split."""
    return filters.without(table(spark, sf_dir, "ift_data").select("split", "profile_id"), F.col("split"), ["test"]).groupBy("split", "profile_id").agg(F.count(F.lit(1)).alias("n"))


def left_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couplet records of source files that no instruction record came from."""
    got = filters.not_done(_poems(spark, sf_dir).select("rec_id", "source_file"), table(spark, sf_dir, "ift_data"), "source_file")
    return got.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def results_with_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written apart from their metadata and joined again by line."""
    r = table(spark, sf_dir, "benchmark_results")
    payload, sidecar = filters.dual_output(r, "result_id", ["raw_output"], ["model", "overall_score"])
    got = filters.with_sidecar(payload, sidecar)
    return got.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("raw_output").alias("answers"), F.round(F.avg("overall_score"), 6).alias("score"))


def benchmark_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poem and line accuracy by model and prompt."""
    return filters.benchmark_breakdown(table(spark, sf_dir, "benchmark_results").select("model", "prompt", "extracted_poem"), "extracted_poem", "model", "prompt")


def code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the poems by class."""
    one = _poems(spark, sf_dir).filter("poem is not null").select(F.explode(F.split("poem", "")).alias("c")).filter("c <> ''")
    return one.groupBy(L.code_point_class(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossed words that are all Telugu or all Kannada letters, as a decoder admits its tokens."""
    w = _poems(spark, sf_dir).select(F.explode(F.map_keys("word_to_word_meaning")).alias("w"))
    return w.groupBy(L.only_script(F.col("w")).alias("telugu"), L.only_script(F.col("w"), r"\x{0C80}", r"\x{0CFF}").alias("kannada")).agg(F.count(F.lit(1)).alias("n"))


def letter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables of the poems by all their classes."""
    s = _poems(spark, sf_dir).select(F.explode(P.pure(P.syllables(F.col("poem")))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("k"))
    return s.select("k", F.explode(L.syllable_classes(F.col("x"))).alias("kind")).groupBy("kind").agg(F.sum("k").alias("n"))


def syllable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, first and last place of every different syllable of every poem."""
    s = _poems(spark, sf_dir).filter("poem is not null").select("rec_id", P.pure(P.syllables(F.col("poem"))).alias("s"))
    e = s.select("rec_id", F.explode(L.positions(F.col("s"))).alias("syllable", "places"))
    return e.select("rec_id", "syllable", F.size("places").cast("bigint").alias("n"), F.array_min("places").cast("bigint").alias("first"), F.array_max("places").cast("bigint").alias("last"))


def text_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description of every poem."""
    return _poems(spark, sf_dir).filter("poem is not null").select("rec_id", L.text_profile(F.col("poem")).alias("p")).select("rec_id", "p.*")


def agreement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written results of rhyme and alliteration of both lines, and what is read back from them."""
    got = metre.analyse(_poems(spark, sf_dir).select("rec_id", "poem"), "poem")
    cols = []
    for k in "12":
        syl, own = F.col(f"syl{k}"), F.get(F.col(f"syl{k}"), F.lit(1))
        third = F.get(syl, F.col(f"feet{k}.a") + F.col(f"feet{k}.b"))
        cols.append(extract.alliteration_text(F.substring(F.get(syl, F.lit(0)), 1, 1), F.substring(third, 1, 1), F.col(f"yati{k}") != "no_match").alias(f"yati_{k}"))
        cols.append(extract.rhyme_text(own, F.get(F.col(f"syl{'21'[int(k) - 1]}"), F.lit(1)), F.col("prasa")).alias(f"rhyme_{k}"))
    out = got.select("rec_id", *cols)
    back = extract.alliteration_read(F.col("yati_1"))
    return out.withColumn("read_first", back["first"]).withColumn("read_matches", back["matches"])


def transliteration_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of transliteration over the poems of each source."""
    got = _poems(spark, sf_dir).filter("poem is not null").select(clean_source(F.col("source")).alias("work"), scripts.quality(F.col("poem")).alias("q"))
    return got.groupBy("work").agg(F.count("q").alias("n"), F.round(F.avg("q"), 6).alias("quality"))


def converted_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glosses with keys and values in Kannada script."""
    m = scripts.converted_map(F.col("word_to_word_meaning"))
    return _poems(spark, sf_dir).filter("word_to_word_meaning is not null").select("rec_id", F.size(m).cast("bigint").alias("n"), digest(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")).alias("entries"))


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a judge with rubric and metadata, and chat turns, of every poem."""
    p = _poems(spark, sf_dir).filter("poem is not null")
    request = instructions.prompt_text("rubric", F.col("poem"), source=F.col("source"), meaning=F.col("telugu_meaning"))
    return p.select("rec_id", digest(request).alias("request"), digest(instructions.chat_turns("gemma", F.coalesce("prompt", F.lit("")), F.col("poem"))).alias("turns"))


def rolling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit rolling hash of every poem."""
    return _poems(spark, sf_dir).filter("poem is not null").select("rec_id", extract.rolling_hash(F.col("poem")).alias("uid"))


def word_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of the two lines of every couplet side by side."""
    two = metre.with_lines(_poems(spark, sf_dir).select("rec_id", "poem"), "poem").filter("line2 is not null")
    c = two.select("rec_id", F.substring_index("line1", " ", 1).alias("a"), F.substring_index("line2", " ", 1).alias("b"))
    got = metre.compared_words(c, "a", "b")
    return got.select("rec_id", F.array_join("common", ",").alias("common"), F.round("class_similarity", 6).alias("class_similarity"), F.round("weight_similarity", 6).alias("weight_similarity"), F.col("longest_run").cast("bigint").alias("longest_run"))


def line_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, valid feet and alliteration of every line of the couplets by itself."""
    two = metre.with_lines(_poems(spark, sf_dir).select("rec_id", "poem"), "poem").filter("line2 is not null")
    one = two.select("rec_id", F.posexplode(F.array("line1", "line2")).alias("k", "line"))
    return metre.analyse_lines(one, "line").select("rec_id", (F.col("k") + 1).alias("k"), "gana", F.col("feet.valid").alias("valid"), "yati")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as pages and read back: heading and text of their sections."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    made = d.select("doc_id", pages.rendered(F.coalesce("source", F.lit("")), F.coalesce("genre", F.lit("none")), F.col("text")).alias("html"))
    return pages.sections(made, "doc_id", "html").select(F.col("id").alias("doc_id"), "no", "heading", digest(F.col("text")).alias("text"))


def normalised_poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems with stripped lines."""
    return _poems(spark, sf_dir).filter("poem is not null").select("rec_id", digest(P.normalised(F.col("poem"))).alias("poem"))


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records by split and profile, and their share."""
    return formats.split_stats(table(spark, sf_dir, "ift_data"), "profile_id")


def begun_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the incremental reader behind the whole poems: lines finished, whether the last one can be and is valid."""
    p = _poems(spark, sf_dir).filter("poem is not null").select("rec_id", F.array_join(P.lines(F.col("poem")), "\n").alias("t"))
    s = prefix_states(p, "rec_id", "t")
    return s.groupBy("line_no", "alive", "accepts").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        field_coverage, profile_feasibility, profile_draws, profile_rows, tiered_profiles, chat_records, analysis_texts, corrupted_couplets, cleaned_documents, line_zones, section_reasons, score_rejects, couplet_errors,
        kept_sources, trained_splits, left_to_fetch, results_with_sidecar, benchmark_methods, code_points, script_words, letter_classes, syllable_places, text_profiles, agreement_texts, transliteration_average,
        converted_glosses, judge_requests, rolling_ids, word_comparison, line_analysis, page_sections, normalised_poems, split_shares, begun_lines,
    )
}

# -- SQL -------------------------------------------------------------------------------------------

_W = A.BLANKS
_STRIP = lambda x: f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"
_SAID = lambda c: f"coalesce({_STRIP(c)}, '')"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LETTER = r"''[\x{0C00}-\x{0C7F}]''"
_NL = "chr(10)"
_TWO = f"coalesce(len(list_filter(list_transform(string_split(poem, {_NL}), lambda l: {_STRIP('l')}), lambda l: l <> '')) >= 2, false)"
_P, _E, _T = f"length({_SAID('poem')}) > 5", f"{_SAID('english_meaning')} <> ''", f"{_SAID('telugu_meaning')} <> ''"
_RICH, _ANY = "coalesce(cardinality(word_to_word_meaning), 0) >= 3", "coalesce(cardinality(word_to_word_meaning), 0) >= 1"
_CA = "chandassu_analysis.line_1 IS NOT NULL AND chandassu_analysis.line_2 IS NOT NULL"
_PR = f"coalesce(len(regexp_extract_all(chandassu_analysis.line_1.prasa_check, '{_LETTER}')) >= 1, false)"
_YT = f"coalesce(len(regexp_extract_all(chandassu_analysis.line_1.yati_check, '{_LETTER}')) >= 2, false)"
_BD = "coalesce(length(chandassu_analysis.line_1.breakdown) > 10, false)"
_LONG = f"coalesce(length({_STRIP(f'split_part(poem, {_NL}, 1)')}) >= 8, false)"
_TELL = f"length({_SAID('telugu_meaning')}) >= 20"
# the table of checks and profiles, written out
_FIELDS = {
    "poem": _P, "two_lines": _TWO, "english_meaning": _E, "telugu_meaning": _T, "gloss_rich": _RICH, "gloss_any": _ANY, "analysis": _CA, "rhyme_letter": _PR, "alliteration_letters": _YT, "breakdown": _BD,
    "tags_telugu": "false", "tags_english": "false", "source": f"{_SAID('source')} <> ''", "long_first_line": _LONG, "telling_meaning": _TELL,
}
_SERVES = {
    "AN1": (_P, _CA, _BD), "AN2": (_P, _CA, _BD), "AN3": (_P, _CA), "AN4": (_P, _RICH), "AN5": (_P, _RICH, _T), "AN6": (_TWO, _BD),
    "RT1": (_TWO,), "RT2": (_TWO,), "RT3": (_TWO,), "RT4": (_P, _E), "RT5": (_P, _T), "RT6": (_TWO, _LONG),
    "GN1": (_P, _E), "GN2": (_P, _E), "GN3": (_P, _T), "GN4": (_TWO,), "GN5": (_P, _E, _PR), "GN6": (_P, _E, _YT), "GN7": (_P, _T, _TELL), "GN8": (_TWO, _T),
    "SP1": (_P, _CA, _PR), "SP2": (_P, _CA, _YT), "SP3": (_P, _CA, _BD), "SP4": (_P, _CA, _RICH), "SP5": (_P, _CA, _ANY, _T), "SP6": (_P, _CA, _RICH),
}
_COUNTED = lambda name, conds: f"SELECT '{name}' AS name, count(*) FILTER ({' AND '.join(conds)}) AS n, count(*) AS total FROM {POEMS}"
_PCT = "n * 100.0::DOUBLE / total"
_U = lambda seed, *ids: f"((('0x' || left(md5({' || '.join([_Q(str(seed)), *[f'{_Q(chr(58))} || {x}' for x in ids]])}), 8))::BIGINT + 1) / 4294967297.0::DOUBLE)"
_KEYS = "k AS (" + " UNION ALL ".join(f"SELECT rec_id, '{p}' AS p, CASE WHEN {' AND '.join(_SERVES[p])} THEN -ln({_U(SEED, 'rec_id', _Q(p))}) / {w}::DOUBLE END AS key FROM {POEMS}" for p, w in DRAW_WEIGHTS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY key, p) AS i FROM k WHERE key IS NOT NULL)"
_ASK = {"GN1": (instructions.ASK_TELUGU, "telugu_meaning", "[Telugu_Bhavam]"), "GN2": (instructions.ASK_ENGLISH, "english_meaning", "[English_Meaning]"), "GN3": (instructions.ASK_TELUGU, "telugu_meaning", "[Human_Style]"), "GN4": (instructions.RULES + instructions.ASK_BY_RULES, "telugu_meaning", "[Scholarly]")}
_CAN = {p: f"nullif({c}, '') IS NOT NULL" for p, (_, c, _) in _ASK.items()}
_LINE = lambda k: f"CASE WHEN chandassu_analysis.{k} IS NOT NULL THEN '{k}: ' || coalesce(chandassu_analysis.{k}.breakdown, '') || ' | Yati: ' || coalesce(chandassu_analysis.{k}.yati_check, '') || ' | Prasa: ' || coalesce(chandassu_analysis.{k}.prasa_check, '') END"
_REPLACED = lambda line, n, by: f"CASE WHEN len(regexp_extract_all({line}, '[\\x{{0C00}}-\\x{{0C7F}}]')) < {n} THEN {line} ELSE regexp_replace({line}, '^((?:[^\\x{{0C00}}-\\x{{0C7F}}]*[\\x{{0C00}}-\\x{{0C7F}}]){{{n - 1}}}[^\\x{{0C00}}-\\x{{0C7F}}]*)[\\x{{0C00}}-\\x{{0C7F}}]', '\\1' || {by}) END"
_CLEANED = lambda extra, digits: _STRIP(f"regexp_replace(CASE WHEN starts_with(l, '#') THEN translate(l, {_Q(cleaning.REMOVED.replace(':', '') + extra)}, '') ELSE " + (f"regexp_replace(translate(l, {_Q(cleaning.REMOVED + extra)}, ''), '[0-9]+[{_W}]*$', '')" if digits else f"translate(l, {_Q(cleaning.REMOVED + extra)}, '')") + " END, '  +', ' ', 'g')")


def _document_sql(name: str, extra: str, digits: bool, part: bool) -> str:
    c = _CLEANED(extra, digits)
    pieces = f"CASE WHEN NOT starts_with(l, '#') AND contains({c}, '-') THEN list_filter(list_transform(string_split({c}, '-'), lambda q: {_STRIP('q')}), lambda q: q <> '') ELSE [{c}] END" if part else f"[{c}]"
    return f"SELECT doc_id, '{name}' AS setting, len(string_split(text, {_NL}))::BIGINT AS lines, text AS whole, array_to_string(flatten(list_transform(string_split(text, {_NL}), lambda l: {pieces})), {_NL}) AS made FROM documents WHERE text IS NOT NULL"


_ZONES = f"l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(text, {_NL}) AS ls FROM documents WHERE text IS NOT NULL)), b AS (SELECT doc_id, min(no) FILTER (NOT starts_with(line, '#')) AS body, min(no) FILTER ({_STRIP('line')} = '---') AS tail FROM l GROUP BY 1)"
_MISSING = ", ".join(f"CASE WHEN {_SAID(c)} = '' THEN '{c}' END" for c in ("prompt", "poem", "telugu_meaning", "english_meaning"))
_BENCH = analysis_sql().replace(f"FROM {POEMS}", "FROM (SELECT result_id AS rec_id, extracted_poem AS poem FROM benchmark_results)")
_IN_CLASS = lambda members: f"contains({_Q(members)}, c)"
_SIGNS_OF = f"translate(array_to_string(regexp_extract_all(x, '[{A.SIGNS}]'), ''), '{A.SIGNS}', '{A.SIGN_VOWELS}')"
_HAS_C = f"regexp_matches(x, '[{A.CONSONANTS}]')"
_ALL = f"x || {_SIGNS_OF} || CASE WHEN {_HAS_C} AND NOT regexp_matches(x, '[{A.SIGNS}]') AND NOT ends_with(x, '{A.VIRAMA}') THEN 'అ' ELSE '' END"
_IS_LONG = f"(regexp_matches(x, '[{A.LONG_SIGNS}]') OR regexp_matches(x, '^[{A.LONG_VOWELS}]$'))"
_IS_VOWEL = f"(regexp_matches(x, '^[{A.VOWELS}]') OR regexp_matches(x, '^[{A.DIACRITICS}]$'))"
# consonants that stand before a virama and another one, as pairs of neighbours in the string
_OTHER = f"len(list_filter(range(1, length(x) - 1), lambda i: contains('{A.CONSONANTS}', x[i]) AND x[i + 1] = '{A.VIRAMA}' AND contains('{A.CONSONANTS}', x[i + 2]) AND x[i] <> x[i + 2])) > 0"
_KINDS = {
    "vowel": _IS_VOWEL, "consonant": _HAS_C, "long": _IS_LONG, "breath": "contains(x, 'ః')", "nasal": "contains(x, 'ం')", "cluster": _OTHER, "double": _DOUBLE,
    "short": f"({_HAS_C} OR {_IS_VOWEL}) AND NOT {_IS_LONG} AND NOT contains(x, 'ం') AND NOT contains(x, 'ః')",
} | {name: f"regexp_matches({_ALL}, '[{members}]')" for name, members in L.LETTER_CLASSES.items()}
_PURE = lambda line: f"list_filter({_syllables_sql(line)}, lambda q: NOT list_contains([' ', {_NL}, 'ఁ', chr(8203), chr(8204), ',', '-', ')', '1', '4'], q))"
_PARTS = lambda x, sep: f"len(list_filter(regexp_split_to_array({x}, '{sep}'), lambda q: regexp_replace(q, '[{_W}]', '', 'g') <> ''))::BIGINT"
_RT, _RF = A.RHYME_TO, A.RHYME_FROM
_TO_KN = "".join(chr(0xC00 + k) for k in range(0x80)), "".join(chr(0xC80 + k) for k in range(0x80))
_QUOTED = lambda x: f"chr(39) || {x} || chr(39)"
_YATI_TEXT = lambda k: f"CASE WHEN yati{k} <> 'no_match' THEN 'Matches: ' ELSE 'No match: ' END || {_QUOTED(f'x{k}')} || ' and ' || {_QUOTED(f'y{k}')} || '.' AS yati_{k}"
_RHYME_TEXT = lambda a, b: f"CASE WHEN rhyme THEN '2nd Letter ' || {_QUOTED(f's{a}')} || ' matches ' || {_QUOTED(f's{b}')} || '.' ELSE 'No match: ' || {_QUOTED(f's{a}')} || ' and ' || {_QUOTED(f's{b}')} || '.' END AS rhyme_{a}"
_LEFT = lambda s: f"left({s}, 1)"

ORACLE_SQL: dict[str, str] = {
    "field_coverage": f"SELECT name AS field, n, round({_PCT}, 4) AS pct, CASE WHEN {_PCT} >= 80 THEN 'good' WHEN {_PCT} >= 40 THEN 'partial' ELSE 'sparse' END AS verdict FROM ({' UNION ALL '.join(_COUNTED(n, [c]) for n, c in _FIELDS.items())})",
    "profile_feasibility": f"SELECT name AS profile_id, n, round({_PCT}, 4) AS pct, CASE WHEN {_PCT} >= 80 THEN 'keep' WHEN {_PCT} >= 50 THEN 'partial' WHEN {_PCT} >= 20 THEN 'risky' ELSE 'drop' END AS verdict FROM ({' UNION ALL '.join(_COUNTED(n, c) for n, c in _SERVES.items())})",
    "profile_draws": f"WITH {_KEYS} SELECT d.rec_id, coalesce(string_agg(p, ',' ORDER BY i) FILTER (i <= 3), '') AS profiles FROM {POEMS} d LEFT JOIN r USING (rec_id) GROUP BY 1",
    "profile_rows": f"WITH {_KEYS}, s AS (SELECT rec_id, CASE WHEN {_U(5, 'rec_id')} < 0.1 THEN 'test' WHEN {_U(5, 'rec_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM {POEMS}) SELECT rec_id, split, p AS profile_id, (i - 1)::INT AS place FROM r JOIN s USING (rec_id) WHERE i <= 3 AND split <> 'test' UNION ALL SELECT rec_id, split, 'GN1', 0 FROM s WHERE split = 'test'",
    "tiered_profiles": f"SELECT rec_id, CASE WHEN {' AND '.join(_SERVES['AN5'])} AND {_U(SEED, 'rec_id')} < 0.55 THEN 'AN5' ELSE 'AN4' END AS profile_id FROM {POEMS} WHERE {' AND '.join(_SERVES['AN4'])}",
    "chat_records": f"WITH c AS (SELECT *, {_U(SEED, 'rec_id')} AS u FROM {POEMS} WHERE {_SAID('poem')} <> ''), d AS (SELECT *, CASE {' '.join(f'WHEN floor(u * 4) = {k} AND {_CAN[p]} THEN {_Q(p)}' for k, p in enumerate(_ASK))} {' '.join(f'WHEN {_CAN[p]} THEN {_Q(p)}' for p in _ASK)} END AS p FROM c) SELECT rec_id, p AS profile_id, CASE p {' '.join(f'WHEN {_Q(p)} THEN {_Q(tag)}' for p, (_, _, tag) in _ASK.items())} END AS source_tag, md5(CASE p {' '.join(f'WHEN {_Q(p)} THEN {_Q(text)} || {c}' for p, (text, c, _) in _ASK.items())} END) AS instruction, md5({_STRIP('poem')}) AS output FROM d WHERE p IS NOT NULL",
    "analysis_texts": f"WITH t AS (SELECT rec_id, coalesce(chandassu_analysis.line_1.breakdown, '') AS b, CASE WHEN cardinality(word_to_word_meaning) > 0 THEN array_to_string(list_transform(map_entries(word_to_word_meaning), lambda e: e.key || ': ' || e.value), {_NL}) ELSE {_Q(instructions.NO_GLOSS)} END AS gloss, coalesce(nullif(concat_ws({_NL}, {_LINE('line_1')}, {_LINE('line_2')}), ''), {_Q(instructions.NO_ANALYSIS)}) AS analysis FROM {POEMS}) SELECT rec_id, length(gloss)::BIGINT AS gloss_length, md5(analysis) AS analysis, CASE WHEN b = '' THEN {_Q(instructions.NO_PATTERN)} WHEN len(regexp_extract_all(b, '\\b[IU]{{2,}}\\b')) > 0 THEN array_to_string(regexp_extract_all(b, '\\b[IU]{{2,}}\\b'), ' | ') ELSE b END AS pattern, CASE WHEN len(regexp_extract_all(b, '\\(([A-Za-z/]+)\\s*[-–]', 1)) > 0 THEN array_to_string(regexp_extract_all(b, '\\(([A-Za-z/]+)\\s*[-–]', 1), ', ') ELSE {_Q(instructions.NO_NAMES)} END AS names FROM t",
    "corrupted_couplets": f"WITH {lines_sql('chandassu_analysis.line_1.prasa_check AS pc, chandassu_analysis.line_1.yati_check AS yc,').replace('SELECT rec_id, chandassu_analysis.line_1.prasa_check AS pc, chandassu_analysis.line_1.yati_check AS yc, ls[1]', 'SELECT rec_id, pc, yc, ls[1]')}, t AS (SELECT *, regexp_extract_all(pc, '''([\\x{{0C00}}-\\x{{0C7F}}])''', 1)[1] AS pl, regexp_extract_all(yc, '''([\\x{{0C00}}-\\x{{0C7F}}])''', 1) AS ys FROM two) SELECT rec_id, 'rhyme' AS kind, pl AS letter, l1 || {_NL} || {_REPLACED('l2', 2, _Q('క') + ' || ' + _Q('')).replace(_Q('క') + ' || ' + _Q(''), 'CASE WHEN pl = ' + _Q('క') + ' THEN ' + _Q('మ') + ' ELSE ' + _Q('క') + ' END')} AS wrong, md5(l1 || {_NL} || l2) AS right FROM t WHERE pl IS NOT NULL UNION ALL SELECT rec_id, 'alliteration', nullif(concat_ws(' మరియు ', ys[1], ys[2]), ''), {_REPLACED('l1', 1, 'CASE WHEN regexp_extract(l1, ' + _Q('[\\x{0C00}-\\x{0C7F}]') + ') = ' + _Q('జ') + ' THEN ' + _Q('క') + ' ELSE ' + _Q('జ') + ' END')} || {_NL} || l2, md5(l1 || {_NL} || l2) FROM t",
    "cleaned_documents": f"SELECT doc_id, setting, lines, (length(whole) - length(made))::BIGINT AS removed, md5(made) AS text FROM ({' UNION ALL '.join(_document_sql(n, *g) for n, g in cleaning.SOURCES.items())})",
    "line_zones": f"WITH {_ZONES} SELECT doc_id, CASE WHEN no < coalesce(body, 1 << 30) THEN 'header' WHEN no >= coalesce(tail, 1 << 30) THEN 'footnote' WHEN starts_with(line, '#') THEN 'note' ELSE 'body' END AS zone, count(*) AS n_lines, min(no)::BIGINT AS first FROM l JOIN b USING (doc_id) GROUP BY 1, 2",
    "section_reasons": f"SELECT CASE WHEN m <> '' THEN 'empty sections: ' || m END AS reason, count(*) AS n FROM (SELECT concat_ws(', ', {_MISSING}) AS m FROM {POEMS}) GROUP BY 1",
    "score_rejects": f"WITH {analysis_sql()} SELECT rec_id, CASE WHEN overall IS NULL THEN 'fewer than two lines' ELSE 'score=' || printf('%.1f', overall) END AS reason FROM {POEMS} LEFT JOIN scored USING (rec_id) WHERE overall IS NULL OR overall <> 100",
    "couplet_errors": f"WITH {analysis_sql()} SELECT CASE WHEN overall IS NULL THEN 'fewer than two lines' END AS error, count(*) AS n, count(*) FILTER (is_valid) AS valid, count(overall) AS scored FROM {POEMS} LEFT JOIN scored USING (rec_id) GROUP BY 1",
    "kept_sources": f"SELECT {CLEAN_SOURCE_SQL} AS work, count(*) AS n FROM {POEMS} GROUP BY 1 HAVING work NOT IN ('synthetic', 'unknown')",
    "trained_splits": "SELECT split, profile_id, count(*) AS n FROM ift_data WHERE split IS DISTINCT FROM 'test' GROUP BY ALL",
    "left_to_fetch": f"SELECT source_file, count(*) AS n FROM {POEMS} WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM ift_data WHERE source_file IS NOT NULL) GROUP BY 1",
    "results_with_sidecar": "SELECT model, count(*) AS n, count(raw_output) AS answers, round(avg(overall_score), 6) AS score FROM benchmark_results GROUP BY 1",
    "code_points": f"SELECT CASE {' '.join(f'WHEN {_IN_CLASS(m)} THEN {_Q(k)}' for k, m in L.CODE_POINTS.items())} ELSE 'OTHER' END AS kind, count(*) AS n FROM (SELECT unnest(string_split(poem, '')) AS c FROM {POEMS} WHERE poem <> '') GROUP BY 1",
    "script_words": f"SELECT regexp_full_match(w, '[\\x{{0C00}}-\\x{{0C7F}} \\n:]+') AS telugu, regexp_full_match(w, '[\\x{{0C80}}-\\x{{0CFF}} \\n:]+') AS kannada, count(*) AS n FROM (SELECT unnest(map_keys(word_to_word_meaning)) AS w FROM {POEMS}) GROUP BY ALL",
    "letter_classes": f"WITH s AS (SELECT x, count(*) AS k FROM ({_SYL_ROWS}) GROUP BY 1) SELECT * FROM ({' UNION ALL '.join(f'SELECT {_Q(t)} AS kind, sum(k) FILTER ({c})::BIGINT AS n FROM s' for t, c in _KINDS.items())}) WHERE n > 0",
    "syllable_places": f"WITH p AS (SELECT rec_id, {_PURE('poem')} AS s FROM {POEMS} WHERE poem IS NOT NULL), e AS (SELECT rec_id, unnest(s) AS syllable, generate_subscripts(s, 1) - 1 AS place FROM p) SELECT rec_id, syllable, count(*) AS n, min(place)::BIGINT AS first, max(place)::BIGINT AS last FROM e GROUP BY ALL",
    "text_profiles": f"WITH t AS (SELECT rec_id, regexp_replace(poem, '[^\\x{{0C00}}-\\x{{0C7F}}\\s\\x{{200B}}]+', '', 'g') AS t FROM {POEMS} WHERE poem IS NOT NULL), s AS (SELECT rec_id, t, {_syllables_sql('t')} AS sy, {_PURE('t')} AS p FROM t), w AS (SELECT *, {_weights_sql('sy', True)} AS w FROM s) SELECT rec_id, length(t)::BIGINT AS characters, {_PARTS('t', f'[{_W}]+')} AS words, {_PARTS('t', '[।॥.?!]')} AS sentences, {_PARTS('t', chr(92) + 'n')} AS paragraphs, len(p)::BIGINT AS syllables, len(list_distinct(p))::BIGINT AS different, len(list_filter(p, lambda q: regexp_matches(q, '[{A.CONSONANTS}]{A.VIRAMA}[{A.CONSONANTS}]')))::BIGINT AS clusters, length(replace(w, 'I', ''))::BIGINT AS heavy, round(CASE WHEN len(p) > 0 THEN length(replace(w, 'I', '')) * 100.0::DOUBLE / len(p) END, 2) AS heavy_pct FROM w",
    "benchmark_methods": f"WITH {_BENCH}, n AS (SELECT rec_id, len(ls) AS k, ls[1] AS l1 FROM raw), one AS (SELECT rec_id, {_weights_sql('sy', True)} AS g FROM (SELECT rec_id, {_syllables_sql('l1')} AS sy FROM n WHERE k = 1)), r AS (SELECT model, prompt, coalesce(s.is_valid, false) AS v, least(coalesce(k, 0), 2) AS lines, coalesce((valid1 = 4)::INT, 0) + coalesce((valid2 = 4)::INT, 0) + coalesce(regexp_full_match(g, '(IIII|IIIU|IIUI|UII|UIU|UUI){{3}}(III|UI)')::INT, 0) AS fine FROM benchmark_results b LEFT JOIN scored s ON s.rec_id = result_id LEFT JOIN n ON n.rec_id = result_id LEFT JOIN one ON one.rec_id = result_id) SELECT model, prompt, count(*) AS poems, count(*) FILTER (v) AS valid_poems, sum(lines)::BIGINT AS lines, sum(fine)::BIGINT AS valid_lines, round(count(*) FILTER (v) * 100.0::DOUBLE / count(*), 4) AS poem_accuracy, round(CASE WHEN sum(lines) > 0 THEN sum(fine) * 100.0::DOUBLE / sum(lines) END, 4) AS line_accuracy FROM r GROUP BY ALL",
    "agreement_texts": f"WITH {analysis_sql()}, f AS (SELECT rec_id, k, {_LEFT('x')} AS x, {_LEFT('y')} AS y FROM kinds), t AS (SELECT d.rec_id, pure1[2] AS s1, pure2[2] AS s2, rhyme, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, yati1, yati2 FROM done d JOIN f p ON p.rec_id = d.rec_id AND p.k = 1 JOIN f q ON q.rec_id = d.rec_id AND q.k = 2), w AS (SELECT rec_id, {_YATI_TEXT('1')}, {_YATI_TEXT('2')}, {_RHYME_TEXT('1', '2')}, {_RHYME_TEXT('2', '1')}, x1, yati1 FROM t) SELECT rec_id, yati_1, rhyme_1, yati_2, rhyme_2, CASE WHEN yati_1 IS NOT NULL THEN x1 END AS read_first, CASE WHEN yati_1 IS NOT NULL THEN yati1 <> 'no_match' END AS read_matches FROM w",
    "transliteration_average": f"WITH q AS (SELECT {CLEAN_SOURCE_SQL} AS work, length(regexp_replace(poem, '[^\\x{{0C05}}-\\x{{0C39}}]', '', 'g')) AS p, length(regexp_replace(poem, '[^\\x{{0C3E}}-\\x{{0C4C}}\\x{{0C02}}\\x{{0C03}}]', '', 'g')) AS s, length(regexp_replace(poem, '[^\\x{{0C4D}}]', '', 'g')) AS c FROM {POEMS} WHERE poem IS NOT NULL) SELECT work, count(*) FILTER (p + s + c > 0) AS n, round(avg((p * 0.99::DOUBLE + s * 0.85::DOUBLE + c * 0.7::DOUBLE) / (p + s + c)) FILTER (p + s + c > 0), 6) AS quality FROM q GROUP BY 1",
    "converted_glosses": f"SELECT rec_id, cardinality(word_to_word_meaning)::BIGINT AS n, md5(array_to_string(list_sort(list_transform(map_entries(word_to_word_meaning), lambda e: translate(e.key, '{_TO_KN[0]}', '{_TO_KN[1]}') || '=' || translate(e.value, '{_TO_KN[0]}', '{_TO_KN[1]}'))), ';')) AS entries FROM {POEMS} WHERE word_to_word_meaning IS NOT NULL",
    "judge_requests": f"SELECT rec_id, md5(concat_ws({_NL} || {_NL}, 'Judge the couplet below from 1 to 5 for each of: metre, rhyme, alliteration, meaning, language.', nullif(concat_ws({_NL}, 'source: ' || source, 'meaning: ' || telugu_meaning), ''), 'Poem:' || {_NL} || poem)) AS request, md5('<start_of_turn>user' || {_NL} || coalesce(prompt, '') || '<end_of_turn>' || {_NL} || '<start_of_turn>model' || {_NL} || poem || '<end_of_turn>') AS turns FROM {POEMS} WHERE poem IS NOT NULL",
    "rolling_ids": f"SELECT rec_id, 'id-' || lower(to_hex(CASE WHEN poem = '' THEN 0 ELSE list_reduce(list_transform(string_split(poem, ''), lambda c: unicode(c)::BIGINT), lambda a, c: (a * 31 + c) % 4294967296) END)) AS uid FROM {POEMS} WHERE poem IS NOT NULL",
    "line_analysis": f"WITH {analysis_sql()} SELECT rec_id, k, gana, valid, yati FROM kinds",
    "page_sections": f"SELECT doc_id, 1 AS no, coalesce(genre, 'none') AS heading, md5(array_to_string(list_filter(list_transform(string_split(text, {_NL}), lambda l: {_STRIP('l')}), lambda l: l <> ''), {_NL})) AS text FROM documents WHERE text IS NOT NULL",
    "normalised_poems": f"SELECT rec_id, md5({_STRIP(f'array_to_string(list_transform(string_split(poem, {_NL}), lambda l: ' + _STRIP('l') + f'), {_NL})')}) AS poem FROM {POEMS} WHERE poem IS NOT NULL",
    "split_shares": "SELECT split, profile_id, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ift_data), 4) AS pct FROM ift_data GROUP BY ALL",
}
