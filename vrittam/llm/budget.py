"""Token budget: estimated tokens per text, and totals by source, language and domain.

A linear model per language predicts tokens from bytes, words, digits, punctuation and letters of
each script. Its normal equations are summed over a bounded, hashed sample of rows that is tokenized; a
second sample gives each language's ratio of true to predicted tokens, which corrects the bias.
All features are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean_source
from .encode import DEFAULT_TOKENIZER, TOKENIZER_DIR, encoder

#: Rows tokenized per language for the fit and as holdout, at most.
FIT_TEXTS, HOLDOUT_TEXTS = 1500, 1500
SCRIPTS = {"telugu": r"\x{0C00}-\x{0C7F}", "kannada": r"\x{0C80}-\x{0CFF}", "latin": r"A-Za-z", "accented": r"\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}"}
FEATURES = ("one", "bytes", "words", "digits", "punctuation", *SCRIPTS)


def _count(text: Column, kind: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]", ""))).cast("double")


def features(text: Column) -> dict[str, Column]:
    """Feature columns of a text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")))
    out = {"one": F.when(t == "", 0.0).otherwise(1.0), "bytes": F.octet_length(t).cast("double"), "words": words.cast("double"), "digits": _count(t, r"\p{Nd}"), "punctuation": _count(t, r"\p{P}")}
    return out | {name: _count(t, span) for name, span in SCRIPTS.items()}


# Words that two of tell English from romanised Telugu.
ENGLISH = "the|of|and|is|are|was|to|in|that|with|for|his|her|he|she|it|on"


def language(f: dict[str, Column], text: Column) -> Column:
    """Language by the script of most letters: te, kn, and of Latin letters en (two English function words, no accents) or te-Latn; ``und`` without letters."""
    english = (f["accented"] == 0) & F.coalesce(text, F.lit("")).rlike(rf"(?is)\b({ENGLISH})\b.*\b({ENGLISH})\b")
    latin = f["latin"] + f["accented"]
    top = F.greatest(f["telugu"], f["kannada"], latin)
    return F.when(top == 0, "und").when(f["telugu"] == top, "te").when(f["kannada"] == top, "kn").when(english, "en").otherwise("te-Latn")


def _tokens(tokenizer: str, folder: str):
    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        enc = encoder(tokenizer, folder)
        return s.map(enc.count).astype("int64")

    return count


def _ranked(rows: DataFrame, fit_texts: int, holdout_texts: int) -> DataFrame:
    """The rows of least hash ``h`` per language, at most as many as wanted, with ``part``: 0 for the fit and 1 for the holdout, interleaved."""
    want = fit_texts + holdout_texts
    rank = F.row_number().over(Window.partitionBy("_language").orderBy("h"))
    upto = lambda k: F.floor(k * F.lit(holdout_texts) / F.lit(want))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= want).withColumn("part", (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("int")).drop("_rank")


def _sample(texts: DataFrame, counts: dict[str, int], fit_texts: int, holdout_texts: int) -> DataFrame:
    """Sample rows by a hash of the whole row: a threshold keeps some more than wanted, the rank makes it exact."""
    want = fit_texts + holdout_texts
    span = 2.0**64
    keep = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (want + 6 * want**0.5 + 30) / n)
        keep = keep | ((F.col("_language") == lang) & (F.col("h").cast("double") <= F.lit(-span / 2 + span * share)))
    return _ranked(texts.filter(keep).withColumn("w", F.lit(1.0)), fit_texts, holdout_texts)


def estimate(df: DataFrame, text_col: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR, fit_texts: int = FIT_TEXTS, holdout_texts: int = HOLDOUT_TEXTS) -> DataFrame:
    """``df`` with ``_language`` and ``_tokens``, the estimated tokens of the text (0 for null and empty ones).

    Sample rows are chosen by a hash of all columns of ``df`` (but maps), so it should have an identifier: then a
    text counts in the samples as often as in the rows. A language without a sampled row, as of few
    different rows, is sampled by its different rows, weighted by their number. One whose sample is too small
    to solve its equations is predicted by its tokens per byte. Only sums over the samples reach the driver.
    """
    f = features(F.col(text_col))
    rows = df.select("*", *[v.alias(f"_f_{k}") for k, v in f.items()])
    rows = rows.withColumn("_language", language({k: F.col(f"_f_{k}") for k in f}, F.col(text_col)))
    cols = [f"_f_{k}" for k in FEATURES]
    texts = rows.filter(F.col("_f_bytes") > 0).select(F.col(text_col).alias("t"), "_language", F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).alias("h"), *cols)
    counts = {r["_language"]: r["n"] for r in texts.groupBy("_language").agg(F.count(F.lit(1)).alias("n")).collect()}
    cross = [F.sum(F.col(a) * F.col(b) * F.col("w")).alias(f"{a}*{b}") for i, a in enumerate(cols) for b in cols[i:]]
    with_y = [F.sum(F.col(a) * F.col("y") * F.col("w")).alias(f"{a}*y") for a in cols]

    def summed(sample: DataFrame) -> list:
        told = sample.withColumn("y", _tokens(tokenizer, folder)("t").cast("double"))
        return told.groupBy("_language", "part").agg(*cross, *with_y, F.sum(F.col("y") * F.col("w")).alias("y"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in cols]).collect()

    sums = summed(_sample(texts, counts, fit_texts, holdout_texts))
    missed = sorted(counts.keys() - {r["_language"] for r in sums})
    if missed:
        few = texts.filter(F.col("_language").isin(missed)).groupBy("_language", "h").agg(*[F.first(c).alias(c) for c in ("t", *cols)], F.count(F.lit(1)).cast("double").alias("w"))
        sums += summed(_ranked(few, fit_texts, holdout_texts))
    weights = {}
    for lang in counts:
        fit = next((r for r in sums if r["_language"] == lang and r["part"] == 0), None)
        held = next((r for r in sums if r["_language"] == lang and r["part"] == 1), None)
        weights[lang] = _solve(fit, held, cols)
    pred = F.lit(0.0)
    for lang, w in weights.items():
        value = sum((F.col(c) * F.lit(float(x)) for c, x in zip(cols, w)), F.lit(0.0))
        pred = F.when(F.col("_language") == lang, value).otherwise(pred)
    return rows.withColumn("_tokens", F.greatest(pred, F.lit(0.0))).drop(*cols)


def _solve(fit, held, cols: list[str]) -> np.ndarray:
    """Ridge solution of a language's normal equations, scaled by the holdout's true over predicted tokens."""
    base = fit or held
    per_byte = base["y"] / max(base["_f_bytes"], 1.0)
    w = np.array([per_byte if c == "_f_bytes" else 0.0 for c in cols])
    if fit and fit["_f_one"] >= 5 * len(cols):
        k = len(cols)
        a = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = fit[f"{cols[i]}*{cols[j]}"]
        scale = np.sqrt(np.maximum(np.diag(a), 1.0))
        rhs = np.array([fit[f"{c}*y"] for c in cols]) - a @ w
        w = w + np.linalg.solve(a / np.outer(scale, scale) + 1e-3 * np.eye(k), rhs / scale) / scale
    if held:
        told = float(np.dot(w, [held[c] for c in cols]))
        if told > 0:
            w = w * (held["y"] / told)
    return w


def token_budget(df: DataFrame, works: DataFrame, text_col: str = "poem", id_col: str = "rec_id", **options) -> DataFrame:
    """``source``, ``language``, ``domain``, ``is_synthetic_data``, ``n_texts``, ``n_tokens``: estimated totals.

    Sources are cleaned; one that is no work has the domain ``unknown``. Null and blank texts are
    left out. A null flag is a group of its own.
    """
    got = estimate(df.select(id_col, text_col, "source", "is_synthetic_data").filter(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\s\p{Z}\p{C}]+", "")) != ""), text_col, **options)
    sums = got.groupBy(clean_source(F.col("source")).alias("source"), F.col("_language").alias("language"), "is_synthetic_data").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("_tokens").alias("n_tokens"))
    domains = works.select(F.col("work").alias("source"), F.col("genre").alias("domain"))
    return sums.join(domains, "source", "left").select("source", "language", F.coalesce("domain", F.lit("unknown")).alias("domain"), "is_synthetic_data", "n_texts", F.round("n_tokens").cast("bigint").alias("n_tokens"))
