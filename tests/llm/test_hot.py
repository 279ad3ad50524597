"""Operators where one key, poem, form or hub holds a large share of the rows: results against plain Python, and rows per task."""

import random

import pytest
from pyspark.sql import functions as F

from vrittam.llm import components, copies, lookalikes, neardup, splits
from vrittam.operators import hotkeys


def made(rng, n, least=2):
    return ["".join(rng.choice("కతపమలసగ") + rng.choice(["", "ా", "ి", "ు"]) for _ in range(rng.randint(least, least + 3))) for _ in range(n)]


def test_hot_keys_are_bounded(spark, monkeypatch):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([50, 40, 30, 3, 2, 1])], "k int, n bigint")
    assert {r.k for r in hotkeys.hot_keys(counts, ["k"], hot_rows=30).collect()} == {0, 1, 2}
    assert hotkeys.hot_keys(counts, ["k"], hot_rows=60) is None and hotkeys.hot_keys(counts.limit(0), ["k"]) is None
    monkeypatch.setattr(hotkeys, "SMALL_ROWS", 3)  # at most three keys can reach a third of all rows
    assert {r.k for r in hotkeys.hot_keys(counts, ["k"], hot_rows=1).collect()} == {0}


def test_salted_join_spreads_a_hot_key(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    hot = hotkeys.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], hot_rows=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = hotkeys.join_hot(left, right, ["k"], hot)
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert got.count() == 9000 and most < 9000 * 0.6
        assert left.join(right, "k").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] > 9000 * 0.6
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cold, warm = hotkeys.apart(left, ["k"], hot)
    assert warm.count() == 4500 + 1 and cold.count() == 4499 and hotkeys.apart(left, ["k"], None)[1] is None


def test_copies_of_one_poem(spark):
    rng = random.Random(1)
    rows = [(i, "క త\nమ" if i % 2 else " ".join(made(rng, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id int, poem string")
    want = {}
    for i, p in rows:
        want.setdefault("".join(p.split()), []).append(i)
    found = {tuple(r) for r in copies.copies_found(df, "rec_id", "poem", hot_rows=100, salts=7).collect()}
    assert found == {(g[0], i) for g in want.values() for i in g[1:]}
    assert {tuple(r) for r in copies.copy_groups(df, "rec_id", "poem", hot_rows=100, salts=7).collect()} == {(g[0], len(g)) for g in want.values()}


def test_lookalikes_of_one_form(spark):
    """Half of the rows are one form, a few others look like it: forms are linked, not rows."""
    rows = [(i, "తంల") for i in range(200)] + [(1000, "త౦ల"), (1001, "తంಲ"), (1002, "తం ల"), (1003, "తమల")]
    df = spark.createDataFrame(rows, "rec_id int, poem string")
    op = lookalikes.Lookalikes(df, "rec_id", "poem", hot_rows=50, salts=5)
    assert op.links().count() == 3 and op.forms.count() == 4
    assert {tuple(r) for r in op.pairs().collect()} == {(i, j) for i in [*range(200), 1002] for j in (1000, 1001) if i < j} | {(1000, 1002), (1001, 1002), (1000, 1001)}


@pytest.mark.parametrize("popular", [3, 10_000])
def test_near_duplicates_of_one_poem(spark, monkeypatch, popular):
    """Half of the records have one poem with different meanings: they are no pairs, but meet nearly equal poems."""
    monkeypatch.setattr(neardup, "POPULAR", popular)
    monkeypatch.setattr(neardup, "HOT_BAND", 4)
    rng = random.Random(2)
    poem, meaning = made(rng, 8), made(rng, 21)
    rows = []
    for i in range(60):
        m = list(meaning)
        m[i % 21] = made(rng, 1, 4)[0]
        p = list(poem)
        if i % 2:
            p[i % 8] = made(rng, 1, 4)[0]
        rows.append((i, " ".join(p), " ".join(m)))
    rows += [(100 + i, " ".join(made(rng, 8)), " ".join(made(rng, 21))) for i in range(40)]
    df = spark.createDataFrame(rows, "rec_id int, poem string, meaning string")
    got = {tuple(r) for r in neardup.NearDuplicates(df, "rec_id", "poem", "meaning").pairs().collect()}
    near = neardup.near
    want = {(a, b) for a, p, m in rows for b, q, n in rows if a < b and p.replace(" ", "") != q.replace(" ", "") and near(p, q, neardup.CHANGED_A) and near(m, n, neardup.CHANGED_B)}
    assert got == want and len(want) > 1000


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "hot_keys", lambda c, on: hotkeys.hot_keys(c, on, hot_rows=20))
    rng = random.Random(3)
    edges = [(500, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(40)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_large_components_are_few(spark, monkeypatch):
    """However small the size from which a component is placed ahead, a bounded number reaches the driver."""
    monkeypatch.setattr(splits, "MOST_LARGE", 4)
    rng = random.Random(4)
    quotes = ["\n".join(" ".join(made(rng, 4)) for _ in range(2)) for _ in range(60)]
    rows = [(i, quotes[i % 60], "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "ift_id int, output string, profile string")
    placed = []
    real = splits._place_large
    monkeypatch.setattr(splits, "_place_large", lambda large, *a: placed.append(len(large)) or real(large, *a))
    out = splits.grouped_splits(df, "ift_id", "output", "profile", large=2, block=20).collect()
    assert len(out) == 600 and placed == [0]
    by = {}
    for r in out:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    share = sum(r.split == "train" for r in out) / 600
    assert abs(share - 0.8) < 0.05
