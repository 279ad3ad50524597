"""The metre on known words and couplets, with an independent plain-Python reading of weights."""

import random

import pytest
from pyspark.sql import functions as F

from vrittam.functions import prosody as P
from vrittam.operators import metre

LIGHT, HEAVY = "కతపమలసగ", "కా తీ పూ మే లో సై గం".split()
#: The feet by their weights, and which place they may take.
FIRST, LAST = ("IIII", "IIIU", "IIUI", "UII", "UIU", "UUI"), ("III", "UI")
# made-up words and their syllables: cluster, final consonant, breath, double
WORDS = {"తమతా": "త మ తా", "కప్మిగ": "క ప్మి గ", "సైమలం": "సై మ లం", "గాన్": "గాన్", "పుఃకమ": "పుః క మ", "లత్తు": "ల త్తు"}
WEIGHED = {"కప్మిగ": "UII", "లత్తు": "UI", "గాన్": "U", "పుఃకమ": "UII", "సైమలం": "UIU"}


def verse_line(rng, initial, rhyme):
    """A valid line: feet one and three begin with one letter, the second syllable has the letter of rhyme."""
    feet = [*rng.choices(FIRST, k=3), rng.choice(LAST)]
    third, weights = len(feet[0]) + len(feet[1]), "".join(feet)
    syl = [(c if w == "I" else c + "ా") for w, c in zip(weights, ({0: initial, 1: rhyme, third: initial}.get(k, rng.choice(LIGHT)) for k in range(len(weights))))]
    cuts = [0, len(feet[0]), third, third + len(feet[2]), len(weights)]
    return " ".join("".join(syl[i:j]) for i, j in zip(cuts, cuts[1:]))


def couplet(rng):
    rhyme = rng.choice(LIGHT)
    return verse_line(rng, rng.choice(LIGHT), rhyme) + "\n" + verse_line(rng, rng.choice(LIGHT), rhyme)


COUPLETS = [couplet(random.Random(k)) for k in range(8)]


def test_syllables_and_weights(spark):
    rng = random.Random(1)
    got = spark.createDataFrame(list(WORDS.items()), "w string, s string").select("s", F.array_join(P.pure(P.syllables(F.col("w"))), " ").alias("g")).collect()
    assert all(r.s == r.g for r in got)
    made = [("".join(rng.choice(LIGHT) if x == "I" else rng.choice(HEAVY) for x in f), f) for f in FIRST + LAST]
    got = spark.createDataFrame(list(WEIGHED.items()) + made, "w string, p string").select("p", P.weights(P.syllables(F.col("w"))).alias("g")).collect()
    assert all(r.p == r.g for r in got)


def test_scope_of_clusters(spark):
    df = spark.createDataFrame([("మ ళ్ళ",)], "l string").select(*[P.weights(P.syllables(F.col("l")), s).alias(s) for s in ("word", "line", "strict")])
    assert df.first().asDict() == {"word": "II", "line": "UI", "strict": "II"}


def test_couplets(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, couplet(rng)) for i in range(60)], "id int, poem string")
    got = metre.analyse(df, "poem").collect()
    assert len(got) == 60 and all(r.is_valid and r.overall == 100.0 and r.feet1.valid == 4 and r.feet2.valid == 4 for r in got)


def test_rhyme_mismatch_and_short(spark):
    rng = random.Random(3)
    bad = verse_line(rng, "క", "త") + "\n" + verse_line(rng, "క", "మ")
    df = spark.createDataFrame([(1, bad), (2, "కమ\nతల"), (3, "one line"), (4, None), (5, ""), (6, "  \n \n"), (7, "క\nర")], "id int, poem string")
    got = {r.id: r for r in metre.analyse(df, "poem").collect()}
    assert set(got) == {1, 2, 7}
    assert not got[1].prasa and not got[2].is_valid and got[7].feet1 is None and got[7].overall == 0.0
    every = {r.id: r for r in metre.analysed(df, "poem").collect()}
    assert set(every) == set(range(1, 8)) and {i for i, r in every.items() if r.error} == {3, 4, 5, 6}
    assert all(every[i].overall is None and every[i].is_valid is None for i in (3, 4, 5, 6)) and every[1].overall == got[1].overall


@pytest.mark.parametrize(("a", "b", "same"), [("అ", "ఆ", True), ("క", "గ", True), ("చ", "శ", True), ("ప", "బ", True), ("ర", "ల", True), ("క", "చ", False), ("ప", "త", False), ("ర", "న", False)])
def test_alliteration_classes(spark, a, b, same):
    got = spark.range(1).select((P.alliteration_class(F.lit(a)) == P.alliteration_class(F.lit(b))).alias("x")).first().x
    assert got == same


@pytest.mark.parametrize(("a", "b", "same"), [("ధా", "ధు", True), ("క్క", "క్కె", True), ("సా", "శా", True), ("రా", "ఱి", True), ("మా", "నా", False)])
def test_rhyme(spark, a, b, same):
    got = spark.range(1).select(P.rhymes(F.array(F.lit("క"), F.lit(a)), F.array(F.lit("క"), F.lit(b))).alias("x")).first().x
    assert got == same


def test_named_foot_in_the_wrong_place(spark):
    """A foot of the other kind has a name, so the line scores 100 on feet but is invalid."""
    df = spark.createDataFrame([("UIUIIIUIUUI",)], "g string").select(P.partition("g").alias("f"))
    f = df.first().f
    assert f.named == 4 and f.valid == 3


def test_line_tables(spark):
    t = metre.line_table(spark)
    assert t.count() == 432 and t.select("pattern").distinct().count() == 432
    p = {r.prefix: r for r in metre.prefix_table(spark).collect()}
    assert p[""].next == "IU" and p[""].least_to_end == 11
    full = {r.pattern for r in t.collect()}
    assert all(r.complete == (k in full) for k, r in p.items())
    assert all(k + x in p for k, r in p.items() for x in r.next)
