"""Small selections and their edge cases."""

from pyspark.sql import functions as F

from vrittam.operators import selection as S


def test_tags(spark):
    df = spark.createDataFrame([([("river", "NOUN"), ("the", "DET"), ("Go", "VERB")], 1), (None, 1), (None, None)], "tags array<struct<token:string,pos:string>>, glossed int")
    df = df.withColumn("gloss", F.when(F.col("glossed") == 1, F.create_map(*[F.lit(x) for x in ("b + c", "x", "a", "y")])))
    got = df.select(S.content_tags(F.col("tags"), ("go",)).alias("c"), S.first_nouns(F.col("tags"), F.col("gloss")).alias("n")).collect()
    assert [t.token for t in got[0].c] == ["river"] and got[0].n == ["river"] and got[1].n == ["b", "a"] and got[2].n == []


def test_ranges_and_texts(spark):
    df = spark.range(1, 21).select("id", F.concat(F.lit("x" * 25), (F.col("id") % 3).cast("string")).alias("t"))
    assert sorted(r.id for r in S.line_range(df, "id", 5, 8).collect()) == [5, 6, 7, 8]
    assert sorted(r.id for r in S.line_range(df, "id", 1, 2).collect()) == [1, 2]
    assert sorted(r.id for r in S.short_texts(df, "t", "id").collect()) == [1, 2, 3]
    assert S.short_texts(df, "t", "id", most=10).count() == 0


def test_mix_and_grid(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "prompt string")
    mix = S.prompt_mix({"p": pool, "q": pool.limit(0)}, 5, 1).collect()
    assert sorted((r.prompt, r.pool) for r in mix) == [("a", "p"), ("b", "p")]
    assert sorted(r.seed for r in S.run_grid(spark, pool.limit(1), 3).collect()) == [42, 49, 56]


def test_tokens_and_outputs(spark):
    tokens = spark.createDataFrame([(1, "కగ"), (2, "క"), (3, ""), (4, None)], "token_id int, token_text string")
    assert {(r.letter, r.n_tokens, r.longest) for r in S.token_letters(tokens).collect()} == {("క", 2, 2), ("గ", 1, 2)}
    letters = spark.createDataFrame([("క",), ("ఝ",)], "letter string")
    assert [r.letter for r in S.uncovered(letters, tokens).collect()] == ["ఝ"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, o string"), spark.createDataFrame([(1, "z")], "id int, o string")
    assert {(r.id, r.tuned) for r in S.side_by_side(a, b, "id", "o").collect()} == {(1, "z"), (2, "N/A")}
    assert S.without_metadata(a.withColumn("_m", F.lit(1))).columns == ["id", "o"]
    assert S.crosscheck(a, F.col("id") > 1, F.col("o") == "y").count() == 2
