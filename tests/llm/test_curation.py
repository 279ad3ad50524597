"""Copies, near-duplicates, overlaps and splits against brute force on small tables, and their edge cases."""

import itertools
import random

import numpy as np
import pytest

from vrittam.llm.couplets import quoted_couplets
from vrittam.llm.superminhash import grams, signatures
from vrittam.llm.textfold import folded_words, letters, skeleton, tight_skeleton
from vrittam.llm import copies, neardup, overlap, splits
from vrittam.llm.components import connected_components

SYL = "కి గూ మ రా లు త్య నం పె సో వి చా జ".split()


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randint(2, 4)))


def test_folding():
    assert skeleton("ａｂ​c") == "abc"
    assert tight_skeleton("м i") != tight_skeleton("m i")  # not alike
    assert tight_skeleton("pа́") == tight_skeleton("pá")  # Cyrillic a with accent
    assert letters("Ab, c!") == "abc" == letters(" a\nB-C")
    assert letters("త౦ಲ") == letters("తంల")
    assert folded_words("ఒక‍,రెండు") == [letters("ఒక"), letters("రెండు")]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        *[(a, b, True) for a, b in ("αa", "ιi", "νv", "ρp", "Il", "O0", "ѵv", "ᎠD", "օo", "೧౧", "೨౨", "ಅఅ", "౦ం", "೦ం", "ａa")],
        ("é", "e\u0301", True),
        ("ﬁ", "fi", True),
        ("a\u200db", "ab", True),
        ("a\u00a0b", "a b", True),
        *[(a, b, False) for a, b in ("ab", "మవ", "–-", "\"'", "Aa")],
        ("x²", "x2", False),
        ("m", "rn", False),
        ("మ", "వు", False),
    ],
)
def test_skeleton_of_the_public_table(a, b, same):
    assert (skeleton(a) == skeleton(b)) is same


def test_copies(spark):
    rows = [(5, "ab c"), (3, "A-b\nC."), (9, "abd"), (1, None), (2, "  "), (4, "..."), (7, "a​bc"), (8, "abd")]
    df = spark.createDataFrame(rows, "rec_id int, poem string").withColumn("key", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    for hot in (2, 1000):  # through both ways
        got = {tuple(r) for r in copies.copies_found(df, "rec_id", "poem", hot_rows=hot, salts=3).collect()}
        assert got == {(3, 5), (3, 7), (8, 9)}
        groups = {tuple(r) for r in copies.copy_groups(df, "rec_id", "poem", hot_rows=hot, salts=3).collect()}
        assert groups == {(3, 3), (8, 2)}
    assert copies.copies_found(df.limit(0), "rec_id", "poem").count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_signatures_estimate_similarity():
    a = [" ".join(f"w{i:03d}" for i in range(0, 60)), " ".join(f"w{i:03d}" for i in range(20, 80)), "", "xy"]
    sig = signatures(*grams(a, 4), 4, 256)
    est = float((sig[0] == sig[1]).mean())
    assert abs(est - 40 / 80) < 0.12
    assert np.isinf(sig[2]).all() and np.isfinite(sig[3]).all()


def test_changed_words():
    n = neardup.changed_words
    assert n("a b c".split(), "c b a".split()) == 0
    assert n("ab cd e".split(), "abcd e".split()) == 0
    assert n("a b c".split(), "a x c y".split()) == 2


def near_table(rng, n=120):
    rows, k = [], 0
    for _ in range(n):
        p, m = [word(rng) for _ in range(8)], [word(rng) for _ in range(21)]
        for _ in range(rng.randint(1, 3)):
            q, o = list(p), list(m)
            for _ in range(rng.randint(0, 4)):
                q[rng.randrange(8)] = word(rng)
            for _ in range(rng.randint(0, 4)):
                o[rng.randrange(21)] = word(rng)
            rng.shuffle(o)
            rows.append((k, " ".join(q[:4]) + "\n" + " ".join(q[4:]), " ".join(o)))
            k += 1
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_table(random.Random(1)) + [(9001, None, "x"), (9002, "a", None), (9003, "", " "), (9004, "a" * 5000, "b" * 5000), (9005, "a" * 5000, "b" * 5000)]
    df = spark.createDataFrame(rows, "rec_id int, poem string, meaning string")
    op = neardup.NearDuplicates(df, "rec_id", "poem", "meaning")
    got = {tuple(r) for r in op.pairs().collect()}
    text = {i: (" ".join(folded_words(p)), " ".join(folded_words(m))) for i, p, m in rows if p and m and p.strip()}
    want = {
        (a, b)
        for a, b in itertools.combinations(sorted(text), 2)
        if text[a][0].replace(" ", "") != text[b][0].replace(" ", "") and neardup.near(text[a][0], text[b][0], neardup.CHANGED_A) and neardup.near(text[a][1], text[b][1], neardup.CHANGED_B)
    }
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 20
    groups = {r.id: r.group_id for r in op.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and groups[9004] == groups[9005] == 9004
    empty = neardup.NearDuplicates(df.limit(0), "rec_id", "poem", "meaning")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    rows, k = [], 0
    for _ in range(260):
        a, b = [word(rng) for _ in range(rng.choice((6, 12, 20)))], [word(rng) for _ in range(rng.choice((8, 10, 30, 45)))]
        for _ in range(rng.randint(1, 3)):
            x, y = list(a), list(b)
            for t in (x, y):
                for _ in range(rng.randint(0, len(t) // 4)):
                    t[rng.randrange(len(t))] = word(rng)
            if rng.random() < 0.3:
                y = y[len(y) // 2 :] + y[: len(y) // 2]
            rows.append((k, " ".join(x), " ".join(y), rng.choice(("train", "train", "val", "test"))))
            k += 1
    rows += [(9001, None, "a b", "val"), (9002, "a", " ", "train"), (9003, "p q", "r", "val"), (9004, "P, q", "r.", "train"), (9005, "p q", "r", None)]
    df = spark.createDataFrame(rows, "ift_id int, instruction string, output string, split string")
    got = {tuple(r) for r in overlap.split_overlaps(df, "ift_id", "instruction", "output", "split").collect()}
    text = {i: (" ".join(folded_words(a)), " ".join(folded_words(b)), s) for i, a, b, s in rows if a and b and b.strip() and s}
    want = {
        (e, t)
        for e in text
        for t in text
        if text[e][2] != "train" and text[t][2] == "train" and neardup.near(text[e][0], text[t][0], overlap.CHANGED) and neardup.near(text[e][1], text[t][1], overlap.CHANGED)
    }
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30 and (9003, 9004) in got
    assert overlap.split_overlaps(df.limit(0), "ift_id", "instruction", "output", "split").count() == 0


@pytest.mark.parametrize(
    ("text", "n"),
    [("అ ఆ ఇ ఈ\nక ఖ గ ఘ", 1), ("పద్యం:\nఅ ఆ ఇ ఈ / క ఖ గ ఘ\n\nభావం: ఒక రెండు. మూడు.", 1), ("మొదటి పద్యం:\nఅ ఆ ఇ ఈ\nక ఖ గ ఘ\n\nరెండవ పద్యం:\nచ ఛ జ ఝ;\n\nట ఠ డ ఢ\n\nముగింపు: సరి.", 2), ("", 0), (None, 0), ("అ ఆ", 0)],
)
def test_quoted_couplets(text, n):
    assert len(quoted_couplets(text)) == n


def test_splits(spark):
    rng = random.Random(5)
    couplets = [" ".join(word(rng) for _ in range(4)) + "\n" + " ".join(word(rng) for _ in range(4)) for _ in range(250)]
    rows, k = [], 0
    for c in couplets:
        for _ in range(rng.randint(1, 5)):
            rows.append((k, c if rng.random() < 0.7 else f"పద్యం:\n{c}\n\nభావం: ఒకటి.", rng.choice("ab")))
            k += 1
    rows += [(k, None, None), (k + 1, " ", "a"), (k + 2, f"మొదటి పద్యం:\n{couplets[0]}\n\nరెండవ పద్యం:\n{couplets[1]}", "b")]
    df = spark.createDataFrame(rows, "ift_id int, output string, profile string")
    got = {r.id: r for r in splits.grouped_splits(df, "ift_id", "output", "profile", block=100, large=10_000).collect()}
    assert set(got) == {r[0] for r in rows}
    by = {}
    for r in got.values():
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    n = len(got)
    share = {s: sum(r.split == s for r in got.values()) / n for s in splits.SPLITS}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02
    links = {tuple(r) for r in splits.linked_records(df, "ift_id", "output", "profile").collect()}
    first = {}
    for i, o, _ in rows:
        for q in quoted_couplets(o):
            first.setdefault(q, i)
    assert all(got[i].component == a for a, i in links) and got[k + 2].component == 0
    # labels keep their shares, and every linked record is in the split of its first
    for label in {r[2] for r in rows}:
        of = [got[r[0]].split for r in rows if r[2] == label]
        assert len(of) < 100 or abs(of.count("train") / len(of) - 0.8) < 0.05
    assert all(got[i].split == got[a].split for a, i in links)
    # one component with most rows is placed whole
    giant = spark.createDataFrame([(i, couplets[0], "a") for i in range(60)] + [(100 + i, couplets[i + 1], "a") for i in range(40)], "ift_id int, output string, profile string")
    res = splits.grouped_splits(giant, "ift_id", "output", "profile", block=10, large=50).collect()
    assert len({r.split for r in res if r.id < 60}) == 1 and len({r.split for r in res}) == 3
    assert splits.grouped_splits(df.limit(0), "ift_id", "output", "profile").count() == 0


def test_overlaps_with_boilerplate_and_hot_classes(spark, monkeypatch):
    """Spans that most records share are spread over tasks; classes of many copies are salted; nothing is lost."""
    monkeypatch.setattr(overlap, "BOILERPLATE", 64)
    monkeypatch.setattr(overlap, "HOT_ROWS", 5)
    rng = random.Random(8)
    tail = [word(rng) for _ in range(9)]
    rows, k = [], 0
    for _ in range(120):
        a, b = [word(rng) for _ in range(9)], [word(rng) for _ in range(10)]
        for _ in range(rng.randint(1, 3)):
            y = list(b)
            y[rng.randrange(len(y))] = word(rng)
            rows.append((k, " ".join(a), " ".join(y + tail), rng.choice(("train", "val"))))
            k += 1
    rows += [(10_000 + i, "same words here", " ".join(tail), "train" if i % 3 else "test") for i in range(30)]
    df = spark.createDataFrame(rows, "ift_id int, instruction string, output string, split string")
    got = {tuple(r) for r in overlap.split_overlaps(df, "ift_id", "instruction", "output", "split").collect()}
    want = {
        (e[0], t[0])
        for e in rows
        for t in rows
        if e[3] != "train" and t[3] == "train" and neardup.near(e[1], t[1], overlap.CHANGED) and neardup.near(e[2], t[2], overlap.CHANGED)
    }
    assert got == want and len(want) > 230


def test_near_duplicates_of_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 5)
    rng = random.Random(9)
    p, m = [word(rng) for _ in range(8)], [word(rng) for _ in range(21)]
    q = [*p[:7], word(rng)]
    rows = [(i, " ".join(p), " ".join(m)) for i in range(40)] + [(100 + i, " ".join(q), " ".join(m)) for i in range(3)]
    df = spark.createDataFrame(rows, "rec_id int, poem string, meaning string")
    got = {tuple(r) for r in neardup.NearDuplicates(df, "rec_id", "poem", "meaning").pairs().collect()}
    assert got == {(a, 100 + b) for a in range(40) for b in range(3)}


def overlap_pairs(rows):
    text = [(i, " ".join(folded_words(a)), " ".join(folded_words(b)), s) for i, a, b, s in rows]
    ev, tr = [x for x in text if x[3] != "train"], [x for x in text if x[3] == "train"]
    return {(e[0], t[0]) for e in ev for t in tr if neardup.near(e[1], t[1], overlap.CHANGED) and neardup.near(e[2], t[2], overlap.CHANGED)}


def overlaps_got(spark, rows):
    df = spark.createDataFrame(rows, "ift_id int, instruction string, output string, split string")
    return {tuple(r) for r in overlap.split_overlaps(df, "ift_id", "instruction", "output", "split").collect()}


def test_overlaps_of_many_variants(spark):
    """All pairs of 500 distinct variants of one record, one word of the output replaced in each."""
    rng = random.Random(11)
    a, b = [word(rng) for _ in range(7)], [word(rng) for _ in range(10)]
    rows = []
    for k in range(500):
        y = list(b)
        y[rng.randrange(len(y))] = f"{word(rng)}{k}"
        rows.append((k, " ".join(a), " ".join(y), "train" if k % 5 else "val"))
    rows += [(1000 + k, " ".join(a), " ".join(word(rng) for _ in range(30)), "train") for k in range(100)]
    rng.shuffle(rows)
    want = overlap_pairs(rows)
    assert len(want) == 100 * 400 and overlaps_got(spark, rows) == want


def test_overlaps_of_few_words(spark, monkeypatch):
    """Outputs of few different words: every kept word is hot, is combined with the instruction's and salted."""
    monkeypatch.setattr(overlap, "BOILERPLATE", 64)
    monkeypatch.setattr(overlap, "HOT_ROWS", 5)
    rng = random.Random(12)
    some = [word(rng) for _ in range(5)]
    heads = [[word(rng) for _ in range(8)] for _ in range(12)]
    rows = []
    for k in range(480):
        a, b = list(rng.choice(heads)), rng.choices(some, k=10)
        a[rng.randrange(8)] = word(rng)
        rows.append((k, " ".join(a), " ".join(b), "train" if k % 4 else "test"))
    rows += [(1000 + k, "a b", " ".join(word(rng) for _ in range(30)), "train") for k in range(100)]
    rng.shuffle(rows)
    want = overlap_pairs(rows)
    assert len(want) > 30 and overlaps_got(spark, rows) == want


def test_overlaps_of_long_texts_in_any_order(spark):
    """A fifth of the words of long outputs replaced and the others shuffled; short ones with words run together."""
    rng = random.Random(13)
    rows = []
    for k in range(120):
        a, b = [word(rng) for _ in range(9)], [word(rng) for _ in range(rng.choice((10, 20, 30, 45, 70)))]
        rows.append((2 * k, " ".join(a), " ".join(b), "train"))
        y = list(b)
        if k % 3:
            for i in rng.sample(range(len(y)), rng.randint(0, len(y) // 5)):
                y[i] = f"{word(rng)}{k}"
            rng.shuffle(y)
        else:
            for i in sorted(rng.sample(range(0, len(y) - 1, 2), len(y) // 4), reverse=True):
                y[i : i + 2] = [y[i] + y[i + 1]]
        rows.append((2 * k + 1, " ".join(a), " ".join(y), "val"))
    want = overlap_pairs(rows)
    assert len(want) >= 120 and overlaps_got(spark, rows) == want


def all_near(rows):
    text = [(i, " ".join(folded_words(a)), " ".join(folded_words(b)), letters(a)) for i, a, b in rows]
    near = neardup.near
    return {(x[0], y[0]) for x, y in itertools.combinations(sorted(text), 2) if x[3] != y[3] and near(x[1], y[1], neardup.CHANGED_A) and near(x[2], y[2], neardup.CHANGED_B)}


def test_near_duplicates_of_one_vocabulary(spark):
    """Records that only share common words are not kept until they are verified: their number would grow with the square of the table."""
    rng = random.Random(21)
    poem, meaning = [word(rng) for _ in range(60)], [word(rng) for _ in range(60)]
    rows = []
    for k in range(800):
        p, m = rng.choices(poem, k=8), rng.choices(meaning, k=12) + meaning[:9]
        rows.append((2 * k, " ".join(p), " ".join(m)))
        if k % 20 == 0:
            p[rng.randrange(8)] = word(rng)
            rows.append((2 * k + 1, " ".join(p), " ".join(rng.sample(m, len(m)))))
    op = neardup.NearDuplicates(spark.createDataFrame(rows, "rec_id int, poem string, meaning string"), "rec_id", "poem", "meaning")
    want = all_near(rows)
    assert len(want) >= 35 and op.candidates().count() <= 3 * len(want)
    assert {tuple(r) for r in op.pairs().collect()} == want


def test_near_duplicates_at_the_limit(spark):
    """Three words of eight and one of seven changed, words too short for a gram of letters, and a meaning run together."""
    rng = random.Random(22)
    short = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3))
    rows = []
    for k in range(150):
        p, m = [short() for _ in range(8)], [short() for _ in range(21)]
        rows.append((2 * k, " ".join(p), " ".join(m)))
        for text, n in ((p, 3), (m, 3)):
            for i in rng.sample(range(len(text)), n):
                text[i] = short()
        rows.append((2 * k + 1, " ".join(rng.sample(p, 8)), " ".join(m)))
    p, m = [word(rng) for _ in range(8)], [word(rng) for _ in range(90)]
    rows += [(1000, " ".join(p), " ".join(m)), (1001, " ".join([*p[:7], "x"]), "".join(m))]
    assert len(rows[-1][2]) > 400
    want = all_near(rows)
    op = neardup.NearDuplicates(spark.createDataFrame(rows, "rec_id int, poem string, meaning string"), "rec_id", "poem", "meaning")
    assert len(want) >= 151 and (1000, 1001) in want and {tuple(r) for r in op.pairs().collect()} == want


def test_groups_of_one_poem(spark):
    """Very many records of one poem whose meanings are near are one group, and no pairs; words may be parted otherwise."""
    rng = random.Random(23)
    p, m = [word(rng) for _ in range(8)], [word(rng) for _ in range(21)]
    text = "".join(p)
    rows = []
    for k in range(neardup.POPULAR + 10):
        y = list(m)
        y[k % 21] = f"{word(rng)}{k}"
        rows.append((k, " ".join(p) if k % 7 else f"{text[:5]} {text[5:]}", " ".join(y)))
    rows += [(1000 + k, " ".join(p), " ".join(word(rng) for _ in range(21))) for k in range(5)]
    op = neardup.NearDuplicates(spark.createDataFrame(rows, "rec_id int, poem string, meaning string"), "rec_id", "poem", "meaning")
    assert {tuple(r) for r in op.groups().collect()} == {(k, 0, neardup.POPULAR + 10) for k in range(neardup.POPULAR + 10)}
    assert op.pairs().count() == 0
