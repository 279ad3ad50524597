"""Analysis of couplets: weights, feet, rhyme, alliteration, score and verdict of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions import prosody as P
from ..functions.extract import bigrams, jaccard, longest_run
from ..functions.letters import syllable_classes


def with_lines(df: DataFrame, poem: str) -> DataFrame:
    """``line1``, ``line2``: the first two non-blank lines; null where there are fewer."""
    return df.withColumn("_lines", P.lines(F.col(poem))).withColumn("line1", F.get("_lines", F.lit(0))).withColumn("line2", F.get("_lines", F.lit(1))).drop("_lines")


def with_syllables(df: DataFrame, scope: str = "word") -> DataFrame:
    """``syl1``, ``syl2`` (pure syllables) and ``gana1``, ``gana2`` (weights) of the two lines."""
    # each array is a column of its own, so it is made once and read by what follows
    df = df.withColumns({f"_all{k}": P.syllables(F.col(f"line{k}")) for k in "12"})
    df = df.withColumns({f"_kept{k}": P.weighed(F.col(f"_all{k}"), scope) for k in "12"} | {f"syl{k}": P.pure(F.col(f"_all{k}")) for k in "12"})
    return df.withColumns({f"gana{k}": P.weigh(F.col(f"_kept{k}"), scope) for k in "12"}).drop("_all1", "_all2", "_kept1", "_kept2")


def with_feet(df: DataFrame) -> DataFrame:
    """``feet1``, ``feet2``: the best divisions into feet."""
    return df.withColumns({f"feet{k}": P.partition(f"gana{k}") for k in "12"})


def with_agreement(df: DataFrame) -> DataFrame:
    """``prasa`` (rhyme), ``yati1``, ``yati2`` (kind of alliteration, null without feet)."""
    df = df.withColumn("prasa", F.coalesce(P.rhymes(F.col("syl1"), F.col("syl2")), F.lit(False)))
    df = df.withColumns({f"_x{k}": F.get(F.col(f"syl{k}"), F.lit(0)) for k in "12"} | {f"_y{k}": F.get(F.col(f"syl{k}"), F.col(f"feet{k}.a") + F.col(f"feet{k}.b")) for k in "12"})
    return df.withColumns({f"yati{k}": P.alliteration(F.col(f"_x{k}"), F.col(f"_y{k}")) for k in "12"}).drop("_x1", "_x2", "_y1", "_y2")


def with_scores(df: DataFrame) -> DataFrame:
    """``overall`` (0 to 100, one decimal) and ``is_valid``.

    Feet weigh 0.40 (25 for each foot with a name, of either kind), rhyme 0.35, alliteration 0.25. A
    line without alliteration scores 0 there but does not make the couplet invalid.
    """
    gana = [F.coalesce(F.col(f"feet{k}.named"), F.lit(0)) * 25.0 for k in "12"]
    yati = [F.when(F.coalesce(F.col(f"yati{k}"), F.lit("no_match")) == "no_match", 0.0).otherwise(100.0) for k in "12"]
    prasa = F.when(F.col("prasa"), 100.0).otherwise(0.0)
    df = df.withColumn("overall", F.round((gana[0] + gana[1]) / 2 * 0.40 + prasa * 0.35 + (yati[0] + yati[1]) / 2 * 0.25, 1))
    fine = [F.coalesce(F.col(f"feet{k}.valid") == 4, F.lit(False)) & F.coalesce(F.col(f"yati{k}") != "no_match", F.lit(True)) for k in "12"]
    return df.withColumn("is_valid", fine[0] & fine[1] & F.col("prasa"))


def analyse(df: DataFrame, poem: str, scope: str = "word") -> DataFrame:
    """All of the above for couplets; texts with fewer than two lines are left out (``df`` keeps its columns).

    Every step is narrow: no shuffle, no join, no Python.
    """
    two = with_lines(df, poem).filter(F.col("line2").isNotNull())
    return with_scores(with_agreement(with_feet(with_syllables(two, scope))))


def analysed(df: DataFrame, poem: str, scope: str = "word") -> DataFrame:
    """:func:`analyse` without leaving out rows: a text of fewer than two lines has ``error`` and null verdicts (its one line is analysed)."""
    got = with_scores(with_agreement(with_feet(with_syllables(with_lines(df, poem), scope))))
    short = F.col("line2").isNull()
    return got.withColumn("error", F.when(short, "fewer than two lines")).withColumns({c: F.when(~short, F.col(c)) for c in ("prasa", "overall", "is_valid")})


def once(df: DataFrame) -> DataFrame:
    """``df`` behind a step that expressions are not pushed through: a filter on long expressions would make them again for every use."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def foot_names(feet: str, gana: str):
    """Names of the four feet of a line as an array; null for a foot without a name."""
    names = F.create_map(*[F.lit(x) for kv in {**A.INDRA, **A.SURYA}.items() for x in kv])
    at = [F.lit(1), F.col(f"{feet}.a") + 1, F.col(f"{feet}.a") + F.col(f"{feet}.b") + 1, F.col(f"{feet}.a") + F.col(f"{feet}.b") + F.col(f"{feet}.c") + 1]
    return F.array(*[F.try_element_at(names, F.substring(F.col(gana), p, F.col(f"{feet}.{k}"))) for p, k in zip(at, "abcd")])


def line_table(spark) -> DataFrame:
    """The valid lines: weights, feet and the place of the third foot. A fixed table of 432 rows, small enough to broadcast."""
    rows = [(p, *f, len(f[0]) + len(f[1]) + 1) for p, *f in A.line_patterns()]
    return spark.createDataFrame(rows, "pattern string, foot1 string, foot2 string, foot3 string, foot4 string, third_at int")


def prefix_table(spark) -> DataFrame:
    """Every beginning of a valid line with the weights that may follow and whether it is complete: reachability and next-weight sets."""
    full = {p for p, *_ in A.line_patterns()}
    begun = {p[:k] for p in full for k in range(len(p) + 1)}
    rows = [(b, "".join(x for x in "IU" if b + x in begun), b in full, min(len(p) for p in full if p.startswith(b)) - len(b)) for b in sorted(begun)]
    return spark.createDataFrame(rows, "prefix string, next string, complete boolean, least_to_end int")


def compared_words(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with two words side by side: ``common``, ``only_first``, ``only_second`` classes, ``class_similarity``, ``weight_similarity``, ``longest_run``.

    Similarities are Jaccard's, of classes and of neighbouring weights. Words without any class have
    the class similarity 0, words without neighbouring weights the other similarity 1; the longest
    common run is one of weights. Null words give nulls.
    """
    made = {}
    for k, word in (("1", a), ("2", b)):
        syl = P.syllables(F.col(word))
        made |= {f"_c{k}": F.array_sort(F.array_distinct(F.flatten(F.transform(P.pure(syl), syllable_classes)))), f"_w{k}": P.weights(syl)}
    got = once(df.withColumns(made))
    c1, c2 = F.col("_c1"), F.col("_c2")
    union = F.size(F.array_union(c1, c2))
    return got.withColumns(
        {
            "common": F.array_sort(F.array_intersect(c1, c2)),
            "only_first": F.array_sort(F.array_except(c1, c2)),
            "only_second": F.array_sort(F.array_except(c2, c1)),
            "class_similarity": F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(c1, c2)) / union),
            "weight_similarity": jaccard(F.array_distinct(bigrams(F.col("_w1"))), F.array_distinct(bigrams(F.col("_w2")))),
            "longest_run": longest_run(F.col("_w1"), F.col("_w2")).cast("int"),
        }
    ).drop("_c1", "_c2", "_w1", "_w2")


def analyse_lines(df: DataFrame, line: str, scope: str = "word") -> DataFrame:
    """``df`` with ``gana``, ``feet``, ``yati`` of single lines: the analysis of a line by itself. Null and blank lines have nulls for the last two."""
    df = df.withColumn("_all", P.syllables(F.col(line)))
    df = df.withColumns({"_kept": P.weighed(F.col("_all"), scope), "_syl": P.pure(F.col("_all"))}).withColumn("gana", P.weigh(F.col("_kept"), scope))
    df = df.withColumn("feet", P.partition("gana"))
    df = df.withColumns({"_x": F.get(F.col("_syl"), F.lit(0)), "_y": F.get(F.col("_syl"), F.col("feet.a") + F.col("feet.b"))})
    return df.withColumn("yati", P.alliteration(F.col("_x"), F.col("_y"))).drop("_all", "_kept", "_syl", "_x", "_y")
