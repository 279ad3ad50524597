"""Profiles, instruction records, filters with reasons, letter classes: small tables with nulls, blanks and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from vrittam.functions import cleaning, extract
from vrittam.functions import letters as L
from vrittam.functions import prosody as P
from vrittam.operators import filters, instructions, lines, metre, profiles
from vrittam.sources.formats import RECORD

LINE = ("తమకా (Bha - UII - Indra) | పూలు", "Matches: 'త' and 'ద'.", "2nd Letter 'మ' matches 'మ'.")


def record(poem, gloss=None, te=None, en=None, analysis=(LINE, LINE), source="s"):
    return ("p", poem, gloss, te, en, analysis, source, None)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record("తమకా లతపు\nకమపా సగలు", {"z": "b", "a + c": "d", "e": "g"}, "మీ" * 12, "meaning"),
        record("abc"),
        record(None, {}, " ", None, None, None),
        record("ఒక పొడవైన పాదం ఇది\n\n రెండవది", {"x": "y"}, "చిన్న", "", (LINE, None), " "),
        record("", None, "", "", None, ""),
    ]
    df = spark.createDataFrame(rows, RECORD).coalesce(1).withColumn("id", F.monotonically_increasing_id()).withColumn("line", F.lit("clash"))
    # a map of a known order
    ordered = F.create_map(*[F.lit(x) for x in ("z", "b", "a + c", "d", "e", "g")])
    return df.withColumn("word_to_word_meaning", F.when(F.col("id") == 0, ordered).otherwise(F.col("word_to_word_meaning")))


def test_checks_and_profiles(records):
    got = [r.asDict() for r in profiles.feasible(records, "id").orderBy("id").collect()]
    can = [{p for p, v in r.items() if p != "id" and v} for r in got]
    assert can[0] == set(profiles.NEEDS)
    assert can[1] == set() and can[2] == set() and can[4] == set()
    assert can[3] == {"AN6", "RT1", "RT2", "RT3", "RT5", "RT6", "GN3", "GN4", "GN8"}
    assert profiles.feasible(records.limit(0), "id").count() == 0
    kept = profiles.tiered(records, "id", 3).collect()
    assert [r.id for r in kept] == [0] and kept[0].profile_id in ("AN4", "AN5")


def test_draws_and_rows(spark, records):
    f = profiles.feasible(records, "id")
    d = profiles.draw(f, {"GN3": 0.5, "GN4": 0.3, "SP1": 0.2}, 2, 1)
    by = {r.id: r.profiles for r in d.collect()}
    assert len(by[0]) == 2 and set(by[3]) == {"GN3", "GN4"} and by[1] == by[2] == by[4] == []
    rows = profiles.exploded(d, F.when(F.col("id") == 3, "test").otherwise("train"), "GN1").collect()
    assert sorted((r.id, r.split, r.place) for r in rows) == [(0, "train", 0), (0, "train", 1), (3, "test", 0)]
    many = spark.range(4000).select(F.col("id"), *[F.lit(True).alias(p) for p in ("GN1", "GN4")])
    n = profiles.draw(many, {"GN1": 0.75, "GN4": 0.25}, 1, 5).filter(F.col("profiles")[0] == "GN1").count()
    assert abs(n / 4000 - 0.75) < 0.03
    assert profiles.keywords(records, "id").orderBy("id").first().keywords == ["z", "a", "e"]  # the order of the map


def test_instructions(records):
    got = {r.id: r for r in instructions.chat_records(records, "id", 1).collect()}
    assert set(got) == {0, 3} and got[3].profile_id != "GN2" and got[3].output == "ఒక పొడవైన పాదం ఇది\n\n రెండవది"
    assert all(r.instruction and r.source_tag for r in got.values())
    texts = {r.id: r for r in instructions.analysis_texts(records, "id").collect()}
    assert texts[0].gloss == "z: b\na + c: d\ne: g" and texts[0].pattern == "UII" and texts[0].names == "Bha"
    assert texts[2].gloss == instructions.NO_GLOSS and texts[2].analysis == instructions.NO_ANALYSIS and texts[2].pattern == instructions.NO_PATTERN
    wrong = {(r.id, r.kind): r for r in instructions.corrupted(records, "id").collect()}
    assert set(wrong) == {(0, "rhyme"), (0, "alliteration"), (3, "rhyme"), (3, "alliteration")}
    assert wrong[0, "rhyme"].wrong == "తమకా లతపు\nకకపా సగలు" and wrong[0, "rhyme"].letter == "మ"
    assert wrong[0, "alliteration"].wrong == "జమకా లతపు\nకమపా సగలు" and wrong[0, "alliteration"].letter == "త మరియు ద"
    assert all(r.wrong != r.right for r in wrong.values())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_requests(spark):
    got = one(spark, instructions.prompt_text("metadata", F.lit("p"), a=F.lit("1"), b=F.lit(None).cast("string")))
    assert got == "Explain the couplet below.\n\na: 1\n\nPoem:\np"
    assert one(spark, instructions.chat_turns("chatml", F.lit("u"), F.lit(None).cast("string"))) == "<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, instructions.chat_turns("llama", F.lit("u"), F.lit("a"))) == "[INST] u [/INST] a</s>"


def test_filters_with_reasons(spark, records):
    got = {r.id: r.reason for r in filters.sections_reason(records, "poem", "telugu_meaning").collect()}
    assert got == {0: None, 1: "empty sections: telugu_meaning", 2: "empty sections: poem, telugu_meaning", 3: None, 4: "empty sections: poem, telugu_meaning"}
    kept, rejected = filters.split_by_reason(filters.score_reason(records.select("id", "poem"), "poem"))
    told = {r.id: r.reason for r in rejected.collect()}
    assert kept.count() + len(told) == 5 and told[1] == told[2] == told[4] == "fewer than two lines" and told[3].startswith("score=")
    assert {r.id for r in filters.without(records, F.col("source"), ["s"]).collect()} == {2, 3, 4}
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    assert {r.id for r in filters.not_done(df, spark.createDataFrame([("a",), (None,)], "k string"), "k").collect()} == {2, 3}
    payload, side = filters.dual_output(df, "id", ["k"], ["id"])
    assert sorted((r.line, r.k, r.id) for r in filters.with_sidecar(payload, side).collect() if r.k) == [(1, "a", 1), (3, "b", 3)]
    b = filters.benchmark_breakdown(records.select("source", "poem"), "poem", "source").collect()
    assert sum(r.poems for r in b) == 5 and sum(r.lines for r in b) == 5 and all(r.line_accuracy is None or 0 <= r.line_accuracy <= 100 for r in b)


def test_letters(spark):
    assert one(spark, F.transform(F.split(F.lit("కఅా్ం \nఁx"), ""), L.code_point_class)) == ["CONSONANT", "INDEPENDENT_VOWEL", "MATRA", "VIRAMA", "DIACRITIC", "SPACE", "NEWLINE", "SKIP", "OTHER"]
    assert one(spark, F.array(*[L.only_script(F.lit(x)) for x in ("తెలుగు: ", "abc", "", "కa")])) == [True, False, False, False]
    assert one(spark, L.syllable_classes(F.lit("క్క"))) == sorted(["consonant", "double", "short", "parusha", "ka_varga", "sparsha", "kanthya"])
    assert "long" in one(spark, L.syllable_classes(F.lit("కై"))) or "pluta" in one(spark, L.syllable_classes(F.lit("కై")))
    assert one(spark, L.positions(P.pure(P.syllables(F.lit("కత కమ"))))) == {"క": [0, 2], "త": [1], "మ": [3]}
    p = one(spark, L.text_profile(F.lit("కా త.\n\nxyz మా")))
    assert (p.words, p.paragraphs, p.syllables, p.heavy) == (3, 2, 3, 2)
    assert one(spark, L.text_profile(F.lit(""))).heavy_pct is None and one(spark, L.text_profile(F.lit(None).cast("string"))).syllables in (None, -1)


def test_word_comparison_against_plain_python(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("క కా క్కి త తం మ్మ అ ఆ".split()) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    df = spark.createDataFrame([(i, words[2 * i], words[2 * i + 1]) for i in range(30)], "id int, a string, b string").withColumn("_w1", F.lit(1))
    weights = lambda c: P.weights(P.syllables(F.col(c)))
    for r in metre.compared_words(df.select("id", "a", "b", weights("a").alias("x"), weights("b").alias("y")), "a", "b").collect():
        pairs = lambda w: {w[i : i + 2] for i in range(len(w) - 1)}
        u = pairs(r.x) | pairs(r.y)
        assert r.weight_similarity == pytest.approx(len(pairs(r.x) & pairs(r.y)) / len(u) if u else 1.0)
        runs = [k for k in range(1, len(r.x) + 1) if any(r.x[i : i + k] in r.y for i in range(len(r.x) - k + 1))]
        assert r.longest_run == max(runs, default=0)


def test_analysis_texts_read_back(spark):
    t = one(spark, extract.alliteration_text(F.lit("క"), F.lit("గ"), F.lit(True)))
    assert t == "Matches: 'క' and 'గ'." and one(spark, extract.alliteration_read(F.lit(t))).asDict() == {"first": "క", "third": "గ", "matches": True}
    assert not one(spark, extract.alliteration_read(F.lit("No match: 'క' and 'త'."))).matches and one(spark, extract.alliteration_read(F.lit("x 'క'"))) is None
    assert one(spark, extract.rhyme_text(F.lit("మా"), F.lit("మి"), F.lit(True))) == "2nd Letter 'మా' matches 'మి'."


def test_cleaning_and_zones(spark):
    got = one(spark, cleaning.clean_text(F.lit("# a: b-c\nక-మ -\n\nత, 12"), "", True, True))
    assert got.text == "# a: b-c\nక\nమ\n\nత" and got.lines == 4 and got.removed == 6
    assert one(spark, cleaning.clean_text(F.lit(None).cast("string"))) is None
    df = spark.createDataFrame([(1, "# t: x\n# u\nక\n# mid\nత\n---\nnote\n# n"), (2, None), (3, ""), (4, "# only")], "doc_id int, text string").withColumn("no", F.lit(0))
    z = {(r.id, r.no): r.zone for r in lines.zones(df, "doc_id", "text").collect()}
    assert [z[1, k] for k in range(1, 9)] == ["header", "header", "body", "note", "body", "footnote", "footnote", "footnote"]
    assert z[3, 1] == "body" and z[4, 1] == "header" and not any(i == 2 for i, _ in z)
