"""Language-model operators: exact round trips, brute force, and edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vrittam.llm.textfold import tight_skeleton, without_ordinary_space
from vrittam.llm import budget, defects, encode, lookalikes, packing, quality
from vrittam.llm.boost import BoostedTrees
from vrittam.llm.holdout import HOLDOUT


@pytest.fixture(scope="module")
def reference():
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encode.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "\n\n a", "it's  we'll\t", "తెలుగు పద్యం's", "a b c", "<|endoftext|>", "��x", "12 345", "''", "x" * 3000, "క" * 500, "a\x1cb\x85c", "🌸మరియు"]


@pytest.mark.parametrize("text", ODD)
def test_encode_known(reference, text):
    e = encode.encoder()
    assert e.encode(text) == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'stlr!.\n\t é1కాంి్తెಲ<|>​　"), max_size=30))
def test_encode_any(text):
    import os

    from tokenizers import Tokenizer

    if not hasattr(test_encode_any, "t"):
        test_encode_any.t = Tokenizer.from_file(os.path.join(encode.TOKENIZER_DIR, "byte_bpe_50k.json"))
        test_encode_any.t.encode_special_tokens = True
    assert encode.encoder().encode(text) == test_encode_any.t.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (98, "same"), (98, "same")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "text as ids")
    got = encode.encode_corpus(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, tuple(r.ids)) for r in got} == {(i, tuple(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = {(r.id, r.n_tokens) for r in encode.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {(r.doc_id, len(r.ids)) for r in got}


def test_lookalikes(spark):
    rows = [(1, "తం ల\nక"), (2, "త౦ ಲ క"), (3, "తం  ల క"), (4, "తం ల క​"), (5, "తం ల గ"), (6, None), (7, " "), (8, "Ab"), (9, "ab"), (10, "ａb"), (11, "á"), (12, "á")]
    df = spark.createDataFrame(rows, "rec_id int, poem string").selectExpr("*", "1 as skeleton", "2 as form")
    texts = {i: t for i, t in rows if t and tight_skeleton(t)}
    want = {(a, b) for a in texts for b in texts if a < b and tight_skeleton(texts[a]) == tight_skeleton(texts[b]) and without_ordinary_space(texts[a]) != without_ordinary_space(texts[b])}
    assert want == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (9, 10), (11, 12)}
    for hot in (2, 1000):
        assert {tuple(r) for r in lookalikes.lookalike_pairs(df, "rec_id", "poem", hot_rows=hot, salts=3).collect()} == want
    assert lookalikes.lookalike_pairs(df.limit(0), "rec_id", "poem").count() == 0
    canon = {r.id: r.canonical for r in lookalikes.canonical_text(df, "rec_id", "poem").collect()}
    assert canon[6] is None and canon[7] == "" and canon[1] == canon[2] == canon[3]


def test_budget(spark):
    rng = random.Random(4)
    rows = []
    for k in range(700):
        text = " ".join("".join(rng.choice("కగతనమలవి ా ుం్యద".replace(" ", "")) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 12)))
        rows.append((k, text, rng.choice(["w_one", "W One", None]), rng.choice([True, False, None])))
    rows += [(900, None, "w_one", True), (901, "", "w_one", True), (902, "plain latin words", "w_one", True), (903, "ಕನ್ನಡ ಪದ್ಯ", "zzz", None), (904, "x" * 20000, "w_one", True)]
    df = spark.createDataFrame(rows, "rec_id int, poem string, source string, is_synthetic_data boolean")
    works = spark.createDataFrame([("w_one", "epic")], "work string, genre string")
    true = sum(encode.encoder().count(r[1]) for r in rows if r[1] and "కగతనమ"[0:0] == "" and any("ఀ" <= c <= "౿" for c in r[1]))
    out = budget.token_budget(df, works).collect()
    told = sum(r.n_tokens for r in out if r.language == "te")
    assert abs(told / true - 1) < 0.02
    assert {r.domain for r in out if r.source == "w_one"} == {"epic"} and {r.domain for r in out if r.source == "zzz"} == {"unknown"}
    assert sum(r.n_texts for r in out) == 703
    assert budget.token_budget(df.limit(0), works).count() == 0


def test_budget_of_repeated_poems(spark):
    """A poem that holds a third of the rows is a third of both samples; they keep their bound; few different rows are no failure."""
    rng = random.Random(14)
    odd = "౧౨౩ ౪౫౬ " * 9
    rows = [(k, odd if k % 3 == 0 else " ".join("".join(rng.choice("కగతనమలవి") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 12)))) for k in range(1500)]
    rows += [(2000 + k, "ಕನ್ನಡ ಪದ್ಯ") for k in range(400)] + [(3000 + k, " \n") for k in range(300)]
    df = spark.createDataFrame(rows, "rec_id int, poem string")
    count = encode.encoder().count
    for got in (df, df.select("poem")):  # without an identifier, equal rows are one sample row
        out = budget.estimate(got, "poem", fit_texts=5, holdout_texts=5).groupBy("_language").sum("_tokens").collect()
        told = {r["_language"]: r["sum(_tokens)"] for r in out}
        assert told["kn"] == pytest.approx(400 * count("ಕನ್ನಡ ಪದ್ಯ")) and told["und"] == pytest.approx(300 * count(" \n"))
    told = budget.estimate(df, "poem", fit_texts=200, holdout_texts=200).filter("_language in ('te', 'und') and poem <> ' \n'").agg({"_tokens": "sum"}).first()[0]
    assert abs(told / sum(count(p) for i, p in rows if i < 1500) - 1) < 0.03
    texts = df.selectExpr("poem as t", "'te' as _language", "xxhash64(rec_id, poem) as h").filter("rec_id < 1500")
    sample = budget._sample(texts, {"te": 1500}, 100, 200).collect()
    assert [sum(r.part == p for r in sample) for p in (0, 1)] == [100, 200]
    assert all(0.2 < sum(r.t == odd for r in sample if r.part == p) / n < 0.47 for p, n in ((0, 100), (1, 200)))


def test_budget_by_source_and_domain(spark):
    """Totals by source, language and domain against the tokenizer, where the sources write differently."""
    rng = random.Random(31)
    syllables = {"one": "క కా కి ల లా త".split(), "two": "గ్మ త్ర్య ష్ట ప్రా క్షీ న్ద్ర".split()}
    rows = []
    for k in range(3000):
        source = ("one", "two")[k % 2]
        kannada_text = k % 5 == 0
        text = "\n".join(" ".join("".join(rng.choice(syllables[source]) for _ in range(rng.randint(2, 5))) for _ in range(4)) for _ in range(2))
        rows.append((k, kannada(text) if kannada_text else text, source, k % 3 == 0))
    rows += [(9000 + k, "the king is in the hall and sings", "one", None) for k in range(50)]
    df = spark.createDataFrame(rows, "rec_id int, poem string, source string, is_synthetic_data boolean")
    works = spark.createDataFrame([("one", "epic"), ("two", "song")], "work string, genre string")
    out = budget.token_budget(df, works, fit_texts=400, holdout_texts=400).collect()
    count = encode.encoder().count
    for source, domain in (("one", "epic"), ("two", "song")):
        told = sum(r.n_tokens for r in out if r.source == source)
        assert told == sum(r.n_tokens for r in out if r.domain == domain)
        assert abs(told / sum(count(r[1]) for r in rows if r[2] == source) - 1) < 0.02
    assert {r.language for r in out} == {"te", "kn", "en"}
    english = sum(r.n_tokens for r in out if r.language == "en")
    assert english == pytest.approx(50 * count("the king is in the hall and sings"), abs=2)


def test_packing_is_spread(spark):
    """Blocks are dealt to a fixed number of tasks, though their rows are few."""
    items = spark.range(3000).selectExpr("id", "cast(pmod(id * 7919, 3000) as int) as n")
    parts = packing.pack(items, "id", "n", windows=8).select("container", F.spark_partition_id().alias("p")).distinct()
    assert parts.select("p").distinct().count() >= 3
    assert packing.tasks(1, 200) == 1 and packing.tasks(160, 4) == 10 and packing.tasks(10**9, 4) == packing.MOST_TASKS


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([5, 80, 300, 700, 1500, 4096, 4097, 9000])) for i in range(800)] + [(900, None), (901, 0), (902, -3), (5, 12), (5, 12)]
    items = spark.createDataFrame(rows, "id int, n int").selectExpr("*", "1 as block", "2 as size")
    got = packing.pack(items, "id", "n", windows=12).collect()
    load, size = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.size
        size[r.id] = size.get(r.id, 0) + r.size
    total = sum(max(n or 0, 0) for _, n in rows)
    assert max(load.values()) <= 4096 and sum(load.values()) == total
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + max(n or 0, 0)
    assert size == want
    pieces = {}
    for r in got:
        pieces[r.id] = pieces.get(r.id, 0) + 1
    assert all(pieces[i] == 1 for i, n in rows if i != 5 and (n or 0) <= 4096)
    assert total / (4096 * len(load)) > 0.9
    assert packing.pack(items.limit(0), "id", "n").count() == 0


def test_differencing():
    w, loads = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(loads.tolist()) == [14, 16] and sum(loads) == 30
    assert {int(np.array([8, 7, 6, 5, 4])[w == k].sum()) for k in (0, 1)} == set(loads.tolist())


LIGHT, HEAVY = "కతపమలవసగ", "కా తీ పూ మే లో వా సై గం".split()


def verse_line(rng, feet=None):
    """A line of three feet of the first kind and one of the second, of made-up words."""
    feet = feet or [*rng.choices(defects.FEET, k=3), rng.choice(defects.LAST_FEET)]
    return " ".join("".join(rng.choice(LIGHT if w == "I" else HEAVY) for w in f) for f in feet)


def kannada(text):
    return "".join(chr(ord(c) + 0x80) if "\u0c00" <= c <= "\u0c7f" else c for c in text)


_R = random.Random(21)
COUPLET = verse_line(_R) + "\n" + verse_line(_R)
ASK = "నది గురించి ద్విపద వ్రాయండి."
CASES = [
    (COUPLET, None),
    (f"Sure, here is the couplet:\n{COUPLET}", None),
    (f"{COUPLET}\n\nభావం: నది నీడలా ఒడ్డున సాగుతుంది. వాన కొండపై వచ్చెను.", None),
    (f"{COUPLET}\n\nభావం: నది నీడలా ఒడ్డున సాగుతుంది. వాన కొండపై వ", "truncated"),
    ("", "empty"),
    (None, "empty"),
    ("\u200b\n", "empty"),
    ("Poem: null", "empty"),
    ("I'm sorry, but I am unable to help with that request.", "refusal"),
    ("క్షమించండి, ఈ పద్యం వ్రాయడం నాకు సాధ్యం కాదు.", "refusal"),
    (ASK, "copy"),
    (f"{ASK} {ASK}", "copy"),
    (COUPLET.split("\n")[0], "truncated"),
    (verse_line(_R, ["UII", "UIU", "IIII", "UI"]) + "\n" + verse_line(_R, ["UII", "UIU", "IIII", "U"]), "truncated"),
    (verse_line(_R, ["UII", "UIU", "IIII", "UI"]) + "\n" + verse_line(_R, ["UII", "UIU"]), "truncated"),
    ("Certainly! The couplet in the", "truncated"),
    (kannada(COUPLET), "language"),
    (f"{ASK}\n\n{COUPLET}", None),
]


def defect_rows():
    rng = random.Random(22)
    filler = []
    for k in range(240):
        w = rng.choice(("నది", "వాన", "కొండ", "గుడి", "పాట"))
        prompt, verse = f"{w} గురించి ద్విపద వ్రాయండి.", verse_line(rng) + "\n" + verse_line(rng)
        prose = f"\n\nభావం: {w} నీడలా ఒడ్డున సాగుతుంది. అది మరియు ఊరికి {rng.choice(('వచ్చెను', 'చేరింది'))}."
        if k % 6 == 0:
            prompt, verse, prose = kannada(prompt), kannada(verse), ""
        filler.append((100 + k, prompt, verse + prose * (k % 2), None))
    return [(i, ASK, a, None) for i, (a, _) in enumerate(CASES)] + filler + [(500, None, kannada(COUPLET), None), (501, "x", "క" * 9000, None), (502, ASK, " ", COUPLET)]


def test_defects(spark):
    df = spark.createDataFrame(defect_rows(), "result_id int, prompt string, raw_output string, extracted_poem string").selectExpr("*", "'x' as defect")
    got = {r.id: r.defect for r in defects.broken_answers(df, "result_id", "prompt", "raw_output", "extracted_poem").collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (_, d) in enumerate(CASES)}
    assert not any(100 <= i < 500 for i in got) and got[500] == "language" and 502 not in got
    assert defects.broken_answers(df.limit(0), "result_id", "prompt", "raw_output").count() == 0


@pytest.mark.parametrize(("part", "lost"), [("languages", "language"), ("lines", "truncated"), ("prose", "truncated")])
def test_defects_need_their_models(part, lost):
    """Without one of the models, defects that it decides are missed or good answers called defective."""
    judge = defects.fit([(p, a) for _, p, a, _ in defect_rows()])
    full = [judge.defect(ASK, a) for a, _ in CASES]
    assert full == [d for _, d in CASES]

    class Blind:
        def best(self, words):
            return "te" if words else ""

        def log_odds(self, tokens):
            return 1.0

    setattr(judge, part, Blind())
    judge._prompts.clear()
    less = [judge.defect(ASK, a) for a, _ in CASES]
    assert [x for x, y in zip(full, less) if x != y] and lost in [x for x, y in zip(full, less) if x != y]


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    m = BoostedTrees(rounds=40).fit(x[:400], y[:400]).calibrate(x[400:500], y[400:500])
    assert ((m.probability(x[500:]) > 0.5) == y[500:]).mean() > 0.93


def test_trees_beat_the_rules_they_learn_from():
    """Half of the hand-labelled documents calibrates, the other is judged; documents the rules leave open count against them."""
    prose = [t for t, y in HOLDOUT if not y]
    rng = random.Random(3)
    texts = [" ".join(rng.sample((p := rng.choice(prose)).split(" "), len(p.split(" ")))) if k % 2 else rng.choice(HOLDOUT[::2])[0] + "\n" + rng.choice(HOLDOUT[::2])[0] for k in range(900)]
    model = quality.fit(texts, HOLDOUT[::2])
    x = np.array([quality.statistics(quality.body(t)) for t, _ in HOLDOUT[1::2]])
    y = np.array([k for _, k in HOLDOUT[1::2]])
    rules = [quality.weak_label(list(row)) for row in x]
    by_trees, by_rules = ((model.probability(x) > 0.5) == y).mean(), np.mean([r == k for r, k in zip(rules, y)])
    assert by_trees >= 0.9 and by_trees > by_rules and any(r is None for r in rules)


def test_quality(spark):
    prose = [t for t, y in HOLDOUT if not y]
    junk = [t for t, y in HOLDOUT if y]
    rows = [(i, prose[i % len(prose)] + f" ({i})." * (i % 2)) for i in range(150)] + [(1000 + i, junk[i % len(junk)] + "\n" + junk[(i + 3) % len(junk)]) for i in range(80)] + [(5000, None), (5001, ""), (5002, " \n"), (5004, "\u200b \u2060"), (5003, "a " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id")
    got = {r.id: r for r in quality.text_quality(df, "doc_id", "text").collect()}
    assert len(got) == len(rows)
    assert all(got[i].connected is None and got[i].n_words == 0 for i in (5000, 5001, 5002, 5004)) and got[5003].connected is False
    right = sum(got[i].connected for i in range(150)) + sum(not got[1000 + i].connected for i in range(80))
    assert right / 230 > 0.9
    assert quality.text_quality(df.limit(0), "doc_id", "text").count() == 0
