"""Letters, verdict variants, divisions, profiles, diversity, reports."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from vrittam import reports
from vrittam.functions import letters as L
from vrittam.operators import diversity, metre, tilings


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_letters(spark):
    assert one(spark, L.articulation(F.lit("గ"))) == "velar" and one(spark, L.articulation(F.lit("అ"))) is None
    assert one(spark, L.tags(F.lit("క్కం"))) == ["consonant", "double", "nasal"]
    assert one(spark, L.tags(F.lit("ఆ"))) == ["long", "vowel"]
    for a, b, v in (("ధా", "ధు", "exact"), ("లా", "ళి", "equivalent"), ("మా", "నా", "mismatch"), ("అ", "నా", "no_consonant")):
        assert one(spark, L.rhyme_verdict(F.lit(a), F.lit(b))) == v
    assert one(spark, L.ragale_valid(F.lit("IIIIIUIIIIIU"))) and not one(spark, L.ragale_valid(F.lit("IIIIIUIIIIII")))
    assert one(spark, L.two_first_feet(F.lit("UIIUUI"))) and not one(spark, L.two_first_feet(F.lit("UIIUI")))
    assert one(spark, L.begins_with_cluster(F.lit("ప్రకట"))) and one(spark, L.ends_light(F.lit("రామ")))


def test_texts(spark):
    c = one(spark, L.text_counts(F.lit("ఒక a. రెండు!\n\nమూడు")))
    assert (c.words, c.sentences, c.paragraphs, c.others) == (4, 3, 2, "!.a")
    assert one(spark, L.body_line(F.lit(" ..... "))) == "....." and one(spark, L.body_line(F.lit("...అ, [వా.రా.] ఆ."))) == "...అ ఆ"
    assert one(spark, L.verse_line(F.lit("“అ ఆ” [3] 12"))) == "అ ఆ" and one(spark, L.verse_line(F.lit(" … "))) is None
    assert one(spark, L.pairs(F.array(*map(F.lit, "abc")))) == ["a\nb", "c"]
    assert one(spark, L.salvaged_objects(F.lit('1. {"a": 1} text 2. {"b": 2}'))) == ['{"a": 1}', '{"b": 2}']
    p = one(spark, L.prompt_and_poem(F.lit("Explain.\nPoem:\nఅ\nఆ")))
    assert p.prompt == "Explain." and p.poem == "అ \nఆ"


def test_divisions():
    feet = tuple(tilings.GENERAL)
    for w in ("".join(x) for n in range(0, 7) for x in itertools.product("IU", repeat=n)):
        want = {" ".join(p) for k in range(1, 4) for p in itertools.product(feet, repeat=k) if "".join(p) == w}
        got = tilings.divisions(w, most=10_000)
        assert set(got) == want and len(got) == len(want)
    assert len(tilings.divisions("I" * 60)) == tilings.MOST and tilings.divisions("") == []


@pytest.mark.parametrize("words", [["a"], ["a", "b"], ["a", "b", "a", "c"], ["a", "a", "a"]])
def test_diversity(spark, words):
    df = spark.createDataFrame([(1, " \n".join(words)), (2, None), (3, " ")], "id int, poem string")
    got = diversity.per_text(df, "id", "poem").collect()
    assert len(got) == 1
    r, n = got[0], len(words)
    counts = [words.count(w) for w in set(words)]
    v, v1 = len(counts), counts.count(1)
    assert r.n_words == n and math.isclose(r.ttr, v / n)
    moving = [len(set(words[i : i + 2])) / 2 for i in range(n - 1)]
    assert math.isclose(r.mattr, v / n if n <= 2 else sum(moving) / len(moving))
    assert math.isclose(r.yules_k, 0 if n == 1 else 1e4 * (sum(c * c for c in counts) - n) / n**2)
    assert math.isclose(r.honores_h, 100 * math.log(n) / (1 - (v1 - 0.5 if v1 == v else v1) / v))
    long = words * 40
    big = spark.createDataFrame([(1, " ".join(long[:70])), (2, " ".join(long[70:]))], "id int, poem string")
    told = diversity.grouped_mattr(big, "id", "poem", window=5).first().mattr
    order = [w for w in dict.fromkeys(long) for _ in range(long.count(w))]
    wins = [len(set(order[i : i + 5])) / 5 for i in range(len(order) - 4)]
    want = sum(wins) / len(wins) if len(order) > 5 else len(set(order)) / len(order)
    assert math.isclose(told, want)


def test_reports(spark):
    assert reports.table([{"a": 1, "b": 2.5}, {"a": None, "b": "x"}], ["a", "b"]).splitlines()[1] == "1  2.5"
    assert "####" in reports.histogram({0: 10, 2: 5}, (0.0, 1.0, 2.0, 3.0))
    row = metre.analyse(spark.createDataFrame([("తోడుగా నిలిచేను తుదిదాక చూడు\nనీడలా సాగేను నిమిషంబు విడువ",)], "p string"), "p").first()
    assert "valid" in reports.couplet_report(row) and "100.0" in reports.couplet_report(row)
