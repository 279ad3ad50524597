"""Queries on cleaning, lines, diversity, validation levels, curation and results, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import cleaning, scripts
from ..functions.names import clean_source
from ..functions.prosody import strip
from ..operators import curate, diversity, lines
from ..operators.hotkeys import small
from ..scratch import table
from .verse import CLEAN_SOURCE_SQL, POEMS, analysis_sql

_W = A.BLANKS


def _t(spark, sf_dir, name, *cols):
    df = table(spark, sf_dir, name)
    return df.select(*cols) if cols else df


# -- cleaning and lines ----------------------------------------------------------------------------


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents after cleaning, counted by length."""
    ls = _t(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return ls.select(F.length(cleaning.clean_line(F.col("l"), trailing_digits=True)).cast("bigint").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the header lines of the documents."""
    h = lines.headers(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return h.select(F.explode("headers").alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def couplets_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.couplets(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("couplet_number").cast("bigint").alias("couplet_number"), "line1", "line2")


def couplet_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.counters(_t(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


# -- diversity -------------------------------------------------------------------------------------


def word_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TTR, moving TTR, Yule's K and Honoré's H of every poem."""
    out = diversity.per_text(_t(spark, sf_dir, POEMS, "rec_id", "poem"), "rec_id", "poem")
    return out.select(F.col("id").alias("rec_id"), "n_words", *[F.round(c, 6).alias(c) for c in ("ttr", "mattr", "yules_k", "honores_h")])


def corpus_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diversity.corpus(_t(spark, sf_dir, POEMS, "poem"), "poem")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def corpus_mattr50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.grouped_mattr(_t(spark, sf_dir, POEMS, "rec_id", "poem"), "rec_id", "poem").select(F.round("mattr", 6).alias("mattr"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.frequencies(_t(spark, sf_dir, POEMS, "telugu_meaning"), "telugu_meaning").orderBy(F.desc("n"), "word").limit(25)


def source_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, types and TTR of the poems per cleaned source; types are merged by two aggregations."""
    w = _t(spark, sf_dir, POEMS, "source", "poem").select(clean_source(F.col("source")).alias("work"), F.explode(diversity.words(F.col("poem"))).alias("word"))
    per = w.groupBy("work", "word").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("work").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_types"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("ttr"))


# -- validation levels -----------------------------------------------------------------------------


def _ratio(df: DataFrame) -> DataFrame:
    """Length of the meaning over that of the poem; 0 for a blank poem."""
    p, m = F.length(F.coalesce(strip(F.col("poem")), F.lit(""))), F.length(F.coalesce(strip(F.col("telugu_meaning")), F.lit("")))
    return df.select("rec_id", F.when(p == 0, 0.0).otherwise(m / p).alias("ratio"))


def level2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ratio(_t(spark, sf_dir, POEMS, "rec_id", "poem", "telugu_meaning"))
    passed = (F.col("ratio") > 0.8) & (F.col("ratio") < 2.5)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("n_pass"), F.round(F.avg("ratio"), 6).alias("mean"), F.round(F.percentile("ratio", 0.5), 6).alias("median"), F.round(F.min("ratio"), 6).alias("least"), F.round(F.max("ratio"), 6).alias("most"))


def ratio_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 records whose ratio is farthest from 1.4."""
    r = _ratio(_t(spark, sf_dir, POEMS, "rec_id", "poem", "telugu_meaning"))
    return r.withColumn("off", F.abs(F.col("ratio") - 1.4)).orderBy(F.desc("off"), F.desc("rec_id")).limit(20).select("rec_id", F.round("ratio", 6).alias("ratio"))


EDGES = (0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.5)


def ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by ratio; below the first edge they are dropped, from the last edge on they count in the last bucket."""
    r = _ratio(_t(spark, sf_dir, POEMS, "rec_id", "poem", "telugu_meaning")).filter(F.col("ratio") >= EDGES[0])
    bucket = F.lit(len(EDGES) - 2)
    for k in reversed(range(len(EDGES) - 2)):
        bucket = F.when(F.col("ratio") < EDGES[k + 1], k).otherwise(bucket)
    return r.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def near_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems that are equal without blanks and punctuation: copies per key of two or more records."""
    p = _t(spark, sf_dir, POEMS, "rec_id", "poem").filter("poem is not null")
    g = p.groupBy(F.md5(cleaning.dedup_key(F.col("poem"))).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_id"))
    return g.filter("n > 1")


def exact_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, POEMS, "rec_id", "poem").filter("poem is not null")
    g = p.groupBy("poem").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_id"))
    return g.filter("n > 1").select("first_id", "n")


def paired_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring pairs of vectors (2k, 2k + 1), with the small term added to each norm."""
    e = _t(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("pair", F.floor(F.col("vec_id") / 2))
    a, b = e.filter("vec_id % 2 = 0").select("pair", F.col("embedding").alias("a")), e.filter("vec_id % 2 = 1").select("pair", F.col("embedding").alias("b"))
    dbl = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(dbl(x), dbl(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sim = dot(F.col("a"), F.col("b")) / ((F.sqrt(dot(F.col("a"), F.col("a"))) + 1e-10) * (F.sqrt(dot(F.col("b"), F.col("b"))) + 1e-10))
    return a.join(b, "pair").select("pair", F.round(sim, 5).alias("similarity"))


def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = paired_cosine(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 4).alias("mean"), F.round(F.percentile("similarity", 0.5), 4).alias("median"), F.min("similarity").alias("least"), F.max("similarity").alias("most"), F.count_if(F.col("similarity") >= 0.65).alias("n_pass"))


def lowest20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_cosine(spark, sf_dir).orderBy("similarity", "pair").limit(20)


def telugu_kannada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems in Kannada letters, whether they come back unchanged, and the expected quality."""
    p = _t(spark, sf_dir, POEMS, "rec_id", "poem").filter("poem is not null")
    kn = scripts.telugu_to_kannada(F.col("poem"))
    return p.select("rec_id", kn.alias("kannada"), (scripts.kannada_to_telugu(kn) == scripts.kannada_to_telugu(F.col("poem"))).alias("comes_back"), F.round(scripts.quality(F.col("poem")), 6).alias("quality"))


def gloss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossed words with the number of records and of different meanings."""
    g = _t(spark, sf_dir, POEMS, "rec_id", "word_to_word_meaning").select("rec_id", F.explode("word_to_word_meaning").alias("word", "meaning"))
    return g.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("meaning").alias("n_meanings"))


def block_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the Telugu block that no poem uses."""
    used = _t(spark, sf_dir, POEMS, "poem").select(F.explode(F.array_distinct(F.split("poem", ""))).alias("letter")).distinct()
    block = spark.range(0x0C00, 0x0C80).select(F.col("id").alias("code"))
    return block.join(used.select(F.conv(F.hex(F.encode("letter", "UTF-16BE")), 16, 10).cast("bigint").alias("code")), "code", "left_anti")


# -- curation --------------------------------------------------------------------------------------


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per work of their poem, looked up in the files: the last file of a poem wins, a miss is unknown."""
    p = _t(spark, sf_dir, POEMS, "rec_id", "poem", "source_file")
    key = strip(F.col("poem"))
    build = p.filter("source_file is not null and poem is not null").select(key.alias("key"), F.split("source_file", "/")[0].alias("work"), "rec_id")
    found = p.select(key.alias("key")).join(curate.lookup_last(build, "key", "work", "rec_id"), "key", "left")
    return found.groupBy(F.coalesce("work", F.lit("unknown")).alias("work")).agg(F.count(F.lit(1)).alias("n"))


def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, POEMS, "rec_id", "poem", "source").filter("poem is not null").withColumn("work", clean_source(F.col("source"))).select("work", "rec_id", "poem")
    return curate.first_wins(p, "poem", "work", "rec_id").select("rec_id", "work")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """250 records as equal over the sources as these allow."""
    p = _t(spark, sf_dir, POEMS, "rec_id", "source").withColumn("work", clean_source(F.col("source"))).select("rec_id", "work")
    return curate.stratified(p, "work", "rec_id", 250, 42)


def split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.exact_splits(_t(spark, sf_dir, POEMS, "rec_id"), "rec_id", 42)


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records per profile with their share beside the one planned, and synthetic ones."""
    n = _t(spark, sf_dir, "ift_data", "profile_id", "is_synthetic").groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_synthetic").alias("n_synthetic"))
    total = n.agg(F.sum("n").alias("total"))
    planned = _t(spark, sf_dir, "profiles", "profile_id", "weight")
    return n.join(small(planned), "profile_id").crossJoin(F.broadcast(total)).select("profile_id", "n", "n_synthetic", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.col("weight").alias("planned"))


def profile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for every couplet record, drawn by hash with the weights of four generation profiles."""
    u = F.conv(F.substring(curate.hashed(7, F.col("rec_id")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return _t(spark, sf_dir, POEMS, "rec_id").select("rec_id", curate.weighted_choice(u, {"GN1": 0.4, "GN2": 0.3, "GN3": 0.2, "GN4": 0.1}).alias("profile_id"))


def training_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instruction record in the three chat formats, as JSON."""
    df = _t(spark, sf_dir, "ift_data", "ift_id", "instruction", "output").filter("instruction is not null and output is not null")
    i, o = F.col("instruction"), F.col("output")
    return df.select("ift_id", F.to_json(curate.alpaca(i, o)).alias("alpaca"), F.to_json(curate.sharegpt(i, o)).alias("sharegpt"), F.to_json(curate.messages(i, o)).alias("messages"))


# -- results ---------------------------------------------------------------------------------------


def poem_lines_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two lines in Telugu script of every answer; null where there are fewer."""
    ls = F.filter(F.transform(F.split("raw_output", "\n"), strip), lambda x: x.rlike(r"[\x{0C00}-\x{0C7F}]"))
    return _t(spark, sf_dir, "benchmark_results", "result_id", "raw_output").filter("raw_output is not null").withColumn("ls", ls).select("result_id", F.when(F.size("ls") >= 2, F.array_join(F.slice("ls", 1, 2), "\n")).alias("poem"))


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark_results", "model", "overall_score", "is_valid", "gana_score", "prasa_score", "yati_score", "error")
    return b.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"), F.round(F.count_if("is_valid") * 100.0 / F.count(F.lit(1)), 4).alias("valid_pct"), F.round(F.avg("overall_score"), 4).alias("score"), F.round(F.avg("gana_score"), 4).alias("gana"), F.round(F.avg("prasa_score"), 4).alias("prasa"), F.round(F.avg("yati_score"), 4).alias("yati"), F.count("error").alias("n_errors"))


def best_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 prompts with the best mean score."""
    b = _t(spark, sf_dir, "benchmark_results", "prompt", "overall_score")
    g = b.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall_score"), 4).alias("score"))
    return g.orderBy(F.desc("score"), F.desc("n"), "prompt").limit(15)


def score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark_results", "model", "overall_score")
    s = F.col("overall_score")
    return b.groupBy("model", F.when(s.isNull(), "none").when(s >= 100, "perfect").when(s >= 75, "high").when(s >= 50, "middle").otherwise("low").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that pass each level, all levels, and all but one."""
    from ..operators import metre

    p = _t(spark, sf_dir, POEMS, "rec_id", "poem", "telugu_meaning")
    l1 = metre.analyse(p.select("rec_id", "poem"), "poem").select("rec_id", "is_valid")
    r = _ratio(p).select("rec_id", ((F.col("ratio") > 0.8) & (F.col("ratio") < 2.5)).alias("p2"))
    key = cleaning.dedup_key(F.col("poem"))
    dup = p.groupBy(F.md5(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id")).filter("key is not null").select("rec_id", F.lit(True).alias("p4"))
    j = r.join(l1, "rec_id", "left").join(dup, "rec_id", "left").select(F.coalesce("is_valid", F.lit(False)).alias("p1"), "p2", F.coalesce("p4", F.lit(False)).alias("p4"))
    a, b, c = F.col("p1"), F.col("p2"), F.col("p4")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("level1"), F.count_if(b).alias("level2"), F.count_if(c).alias("level4"), F.count_if(a & b & c).alias("all_levels"), F.count_if(~a & b & c).alias("only_level1_fails"), F.count_if(a & ~b & c).alias("only_level2_fails"), F.count_if(a & b & ~c).alias("only_level4_fails"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (clean_lines, header_values, couplets_from_lines, couplet_counters, word_metrics, corpus_lexical, corpus_mattr50, top_words, source_ttr, level2_ratio, ratio_outliers, ratio_histogram, near_key_groups, exact_copy_groups, paired_cosine, similarity_stats, lowest20, telugu_kannada, gloss_terms, block_letters, source_lookup, first_wins_dedup, stratified_sample, split_80_10_10, profile_counts, profile_choice, training_formats, poem_lines_of_answers, benchmark_summary, best_prompts, score_bins, level_summary)
}

# -- SQL -------------------------------------------------------------------------------------------

_STRIP = lambda x: f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '[{_W}]+'), lambda q: q <> '')"
_CLEAN_SQL = f"""{_STRIP(f"regexp_replace(CASE WHEN starts_with(l, '#') THEN translate(l, {_Q(cleaning.REMOVED.replace(':', ''))}, '') ELSE regexp_replace(translate(l, {_Q(cleaning.REMOVED)}, ''), '[0-9]+[{_W}]*$', '') END, '  +', ' ', 'g')")}"""
_NUMBERED = f"n0 AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)), n1 AS (SELECT doc_id, no, {_STRIP('l')} AS line FROM n0)"
_GROUPS = f"""{_NUMBERED}, stop AS (SELECT doc_id, min(no) AS s FROM n1 WHERE line = '---' GROUP BY 1), n2 AS (SELECT n1.* FROM n1 LEFT JOIN stop USING (doc_id) WHERE s IS NULL OR no < s),
n3 AS (SELECT *, (line = '' OR starts_with(line, '#')) AS border FROM n2), n4 AS (SELECT *, count(*) FILTER (border) OVER (PARTITION BY doc_id ORDER BY no) AS grp FROM n3),
g AS (SELECT doc_id, grp, no, {_STRIP("regexp_replace(line, '" + lines.ANNOTATION + "', '', 'g')")} AS line FROM n4 WHERE NOT border), g2 AS (SELECT * FROM g WHERE line <> ''),
pr AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, grp ORDER BY no) AS line2 FROM g2), fl AS (SELECT *, regexp_matches(line, '{lines.DAMAGED}') OR regexp_matches(line2, '{lines.DAMAGED}') AS bad FROM pr)"""
_RATIO = f"r AS (SELECT rec_id, CASE WHEN length(coalesce({_STRIP('poem')}, '')) = 0 THEN 0.0 ELSE length(coalesce({_STRIP('telugu_meaning')}, '')) / length({_STRIP('poem')})::DOUBLE END AS ratio FROM {POEMS})"
_KEY = "translate(poem, chr(10) || ' ,.-;:!?()\"''।॥', '')"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"c AS (SELECT vec_id // 2 AS pair, any_value(embedding) FILTER (vec_id % 2 = 0) AS a, any_value(embedding) FILTER (vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1), s AS (SELECT pair, round({_DOT('a', 'b')} / ((sqrt({_DOT('a', 'a')}) + 1e-10) * (sqrt({_DOT('b', 'b')}) + 1e-10)), 5) AS similarity FROM c WHERE a IS NOT NULL AND b IS NOT NULL)"
_HONORE = "100.0 * ln(n) / (1.0 - CASE WHEN v1 = v THEN v1 - 0.5 ELSE v1 END / v::DOUBLE)"

ORACLE_SQL: dict[str, str] = {
    "clean_lines": f"SELECT length({_CLEAN_SQL})::BIGINT AS length, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1",
    "couplets_from_lines": f"WITH {_GROUPS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS couplet_number, line AS line1, line2 FROM fl WHERE line2 IS NOT NULL AND NOT bad",
    "couplet_counters": f"WITH {_GROUPS}, c AS (SELECT doc_id, grp, count(*) AS n, count(*) FILTER (line2 IS NOT NULL AND bad) AS b, count(*) FILTER (line2 IS NOT NULL AND NOT bad) AS ok FROM fl GROUP BY 1, 2) SELECT count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n = 3) AS triplets, coalesce(sum(ok), 0)::BIGINT AS couplets, coalesce(sum(b), 0)::BIGINT AS discarded FROM c",
    "header_values": f"WITH {_NUMBERED}, f AS (SELECT doc_id, coalesce(min(no) FILTER (NOT starts_with(line, '#')), 1000000000) AS s FROM n1 GROUP BY 1), h AS (SELECT n1.doc_id, no, {_STRIP("regexp_replace(line, '^#+', '')")} AS c FROM n1 JOIN f USING (doc_id) WHERE no < s AND contains(line, ':')), kv AS (SELECT doc_id, no, {_STRIP("split_part(c, ':', 1)")} AS key, {_STRIP("regexp_replace(c, '^[^:]*:', '')")} AS value FROM h) SELECT key, value, count(*) AS n FROM (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY no DESC) = 1) GROUP BY 1, 2",
    "word_metrics": f"""WITH w AS (SELECT rec_id, {_WORDS('poem')} AS w FROM {POEMS} WHERE poem IS NOT NULL), x AS (SELECT rec_id, unnest(w) AS word FROM w), f AS (SELECT rec_id, word, count(*) AS k FROM x GROUP BY 1, 2), a AS (SELECT rec_id, sum(k)::BIGINT AS n, count(*) AS v, count(*) FILTER (k = 1) AS v1, sum(k * k)::DOUBLE AS sq FROM f GROUP BY 1),
m AS (SELECT rec_id, list_avg(list_transform(range(1, greatest(len(w), 2)), lambda i: len(list_distinct(list_slice(w, i, i + 1))) / 2.0)) AS m FROM w WHERE len(w) > 0)
SELECT rec_id, n AS n_words, round(v / n::DOUBLE, 6) AS ttr, round(CASE WHEN n <= 2 THEN v / n::DOUBLE ELSE m END, 6) AS mattr, round(CASE WHEN n = 1 THEN 0.0 ELSE 1e4 * (sq - n) / (n::DOUBLE * n) END, 6) AS yules_k, round({_HONORE}, 6) AS honores_h FROM a JOIN m USING (rec_id)""",
    "corpus_lexical": f"WITH f AS (SELECT word, count(*) AS k FROM (SELECT unnest({_WORDS('poem')}) AS word FROM {POEMS}) GROUP BY 1), a AS (SELECT sum(k)::BIGINT AS n, count(*) AS v, count(*) FILTER (k = 1) AS v1, count(*) FILTER (k = 2) AS v2, sum(k * k)::DOUBLE AS sq FROM f) SELECT n AS n_words, v AS n_types, v1 AS hapax, v2 AS dis, round(v / n::DOUBLE, 6) AS ttr, round(v1 / v::DOUBLE, 6) AS hapax_ratio, round(v2 / v::DOUBLE, 6) AS sichels_s, round(1e4 * (sq - n) / (n::DOUBLE * n), 6) AS yules_k, round({_HONORE}, 6) AS honores_h FROM a",
    "corpus_mattr50": f"WITH p AS (SELECT rec_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT rec_id, {_WORDS('poem')} AS w FROM {POEMS} WHERE poem IS NOT NULL)), f AS (SELECT word, min((rec_id, pos)) AS first FROM p GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY first) AS i, word FROM p JOIN f USING (word)), d AS (SELECT i, count(DISTINCT word) OVER (ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS k FROM s) SELECT round(avg(k / 50.0), 6) AS mattr FROM d WHERE i >= 50",
    "top_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS('telugu_meaning')}) AS word FROM {POEMS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 25",
    "source_ttr": f"SELECT work, count(*) AS n_words, count(DISTINCT word) AS n_types, round(count(DISTINCT word) / count(*)::DOUBLE, 6) AS ttr FROM (SELECT {CLEAN_SOURCE_SQL} AS work, unnest({_WORDS('poem')}) AS word FROM {POEMS}) GROUP BY 1",
    "level2_ratio": f"WITH {_RATIO} SELECT count(*) AS n, count(*) FILTER (ratio > 0.8 AND ratio < 2.5) AS n_pass, round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.5), 6) AS median, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most FROM r",
    "ratio_outliers": f"WITH {_RATIO} SELECT rec_id, round(ratio, 6) AS ratio FROM r ORDER BY abs(ratio - 1.4) DESC, rec_id DESC LIMIT 20",
    "ratio_histogram": f"WITH {_RATIO} SELECT (least({' + '.join(f'(ratio >= {e})::INT' for e in EDGES)}, {len(EDGES) - 1}) - 1)::INT AS bucket, count(*) AS n FROM r WHERE ratio >= {EDGES[0]} GROUP BY 1",
    "near_key_groups": f"SELECT md5({_KEY}) AS key, count(*) AS n, min(rec_id) AS first_id FROM {POEMS} WHERE poem IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "exact_copy_groups": f"SELECT min(rec_id) AS first_id, count(*) AS n FROM {POEMS} WHERE poem IS NOT NULL GROUP BY poem HAVING count(*) > 1",
    "paired_cosine": f"WITH {_COS} SELECT pair, similarity FROM s",
    "similarity_stats": f"WITH {_COS} SELECT count(*) AS n, round(avg(similarity), 4) AS mean, round(quantile_cont(similarity, 0.5), 4) AS median, min(similarity) AS least, max(similarity) AS most, count(*) FILTER (similarity >= 0.65) AS n_pass FROM s",
    "lowest20": f"WITH {_COS} SELECT pair, similarity FROM s ORDER BY similarity, pair LIMIT 20",
    "telugu_kannada": f"SELECT rec_id, translate(poem, '{scripts.TELUGU}', '{scripts.KANNADA}') AS kannada, translate(translate(poem, '{scripts.TELUGU}', '{scripts.KANNADA}'), '{scripts.KANNADA}', '{scripts.TELUGU}') = translate(poem, '{scripts.KANNADA}', '{scripts.TELUGU}') AS comes_back, round((a * 0.99::DOUBLE + b * 0.85::DOUBLE + c * 0.70::DOUBLE) / nullif(a + b + c, 0), 6) AS quality FROM (SELECT rec_id, poem, len(regexp_extract_all(poem, '[\\x{{0C05}}-\\x{{0C39}}]')) AS a, len(regexp_extract_all(poem, '[\\x{{0C3E}}-\\x{{0C4C}}\\x{{0C02}}\\x{{0C03}}]')) AS b, len(regexp_extract_all(poem, '\\x{{0C4D}}')) AS c FROM {POEMS} WHERE poem IS NOT NULL)",
    "gloss_terms": f"SELECT word, count(*) AS n, count(DISTINCT meaning) AS n_meanings FROM (SELECT unnest(map_keys(word_to_word_meaning)) AS word, unnest(map_values(word_to_word_meaning)) AS meaning FROM {POEMS}) GROUP BY 1",
    "block_letters": f"SELECT code FROM range({0x0C00}, {0x0C80}) r(code) WHERE chr(code::INT) NOT IN (SELECT DISTINCT unnest(string_split(poem, '')) FROM {POEMS} WHERE poem IS NOT NULL)",
    "source_lookup": f"WITH b AS (SELECT {_STRIP('poem')} AS key, arg_max(split_part(source_file, '/', 1), rec_id) AS work FROM {POEMS} WHERE source_file IS NOT NULL AND poem IS NOT NULL GROUP BY 1) SELECT coalesce(work, 'unknown') AS work, count(*) AS n FROM (SELECT {_STRIP('poem')} AS key FROM {POEMS}) p LEFT JOIN b USING (key) GROUP BY 1",
    "first_wins_dedup": f"SELECT rec_id, work FROM (SELECT rec_id, poem, {CLEAN_SOURCE_SQL} AS work FROM {POEMS} WHERE poem IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY poem ORDER BY work, rec_id) = 1",
    "split_80_10_10": f"WITH o AS (SELECT rec_id, row_number() OVER (ORDER BY md5('42:' || rec_id), rec_id) AS k, count(*) OVER () AS n FROM {POEMS}) SELECT rec_id, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'test' WHEN k <= 2 * greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM o",
    "profile_counts": "SELECT profile_id, count(*) AS n, count(*) FILTER (is_synthetic) AS n_synthetic, round(count(*) / (SELECT count(*) FROM ift_data)::DOUBLE, 6) AS share, any_value(weight) AS planned FROM ift_data JOIN profiles USING (profile_id) GROUP BY 1",
    "profile_choice": f"SELECT rec_id, CASE WHEN u < 0.4 THEN 'GN1' WHEN u < 0.7 THEN 'GN2' WHEN u < 0.9 THEN 'GN3' ELSE 'GN4' END AS profile_id FROM (SELECT rec_id, ('0x' || left(md5('7:' || rec_id), 8))::BIGINT / 4294967296.0 AS u FROM {POEMS})",
    "poem_lines_of_answers": f"SELECT result_id, CASE WHEN len(ls) >= 2 THEN ls[1] || chr(10) || ls[2] END AS poem FROM (SELECT result_id, list_filter(list_transform(string_split(raw_output, chr(10)), lambda x: {_STRIP('x')}), lambda x: regexp_matches(x, '[\\x{{0C00}}-\\x{{0C7F}}]')) AS ls FROM benchmark_results WHERE raw_output IS NOT NULL)",
    "benchmark_summary": "SELECT model, count(*) AS n, count(*) FILTER (is_valid) AS n_valid, round(count(*) FILTER (is_valid) * 100.0::DOUBLE / count(*), 4) AS valid_pct, round(avg(overall_score), 4) AS score, round(avg(gana_score), 4) AS gana, round(avg(prasa_score), 4) AS prasa, round(avg(yati_score), 4) AS yati, count(error) AS n_errors FROM benchmark_results GROUP BY 1",
    "best_prompts": "SELECT prompt, count(*) AS n, round(avg(overall_score), 4) AS score FROM benchmark_results GROUP BY 1 ORDER BY score DESC, n DESC, prompt LIMIT 15",
    "score_bins": "SELECT model, CASE WHEN overall_score IS NULL THEN 'none' WHEN overall_score >= 100 THEN 'perfect' WHEN overall_score >= 75 THEN 'high' WHEN overall_score >= 50 THEN 'middle' ELSE 'low' END AS bin, count(*) AS n FROM benchmark_results GROUP BY 1, 2",
}

ORACLE_SQL["level_summary"] = f"""WITH {analysis_sql()}, {_RATIO}, d AS (SELECT min(rec_id) AS rec_id FROM {POEMS} WHERE poem IS NOT NULL GROUP BY {_KEY}),
j AS (SELECT coalesce(is_valid, false) AS a, ratio > 0.8 AND ratio < 2.5 AS b, d.rec_id IS NOT NULL AS c FROM r LEFT JOIN scored USING (rec_id) LEFT JOIN d USING (rec_id))
SELECT count(*) AS n, count(*) FILTER (a) AS level1, count(*) FILTER (b) AS level2, count(*) FILTER (c) AS level4, count(*) FILTER (a AND b AND c) AS all_levels, count(*) FILTER (NOT a AND b AND c) AS only_level1_fails, count(*) FILTER (a AND NOT b AND c) AS only_level2_fails, count(*) FILTER (a AND b AND NOT c) AS only_level4_fails FROM j"""
ORACLE_SQL["stratified_sample"] = f"""WITH RECURSIVE p AS (SELECT rec_id, {CLEAN_SOURCE_SQL} AS work FROM {POEMS}), c AS (SELECT work, count(*) AS n FROM p GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n, work) AS k, sum(n) OVER (ORDER BY n, work) - n AS before, count(*) OVER () AS groups FROM c),
cut AS (SELECT min(k) AS k FROM o WHERE n > (250 - before) // (groups - k + 1)), rest AS (SELECT o.work, row_number() OVER (ORDER BY o.work) AS i, (SELECT 250 - before FROM o x, cut WHERE x.k = cut.k) AS lft, count(*) OVER () AS m FROM o, cut WHERE o.k >= cut.k),
q AS (SELECT work, n AS quota FROM o WHERE k < coalesce((SELECT k FROM cut), 1000000) UNION ALL SELECT work, lft // m + (i <= lft % m)::INT FROM rest)
SELECT rec_id, work FROM (SELECT rec_id, work, quota, row_number() OVER (PARTITION BY work ORDER BY md5('42:' || rec_id), rec_id) AS k FROM p JOIN q USING (work)) WHERE k <= quota"""

ORACLE_SQL["training_formats"] = """SELECT ift_id, to_json({'instruction': instruction, 'input': '', 'output': output})::VARCHAR AS alpaca,
to_json({'conversations': [{'from': 'human', 'value': instruction}, {'from': 'gpt', 'value': output}]})::VARCHAR AS sharegpt,
to_json({'messages': [{'role': 'user', 'content': instruction}, {'role': 'assistant', 'content': output}]})::VARCHAR AS messages FROM ift_data WHERE instruction IS NOT NULL AND output IS NOT NULL"""
