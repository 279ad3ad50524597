"""Visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hotkeys import HOT_ROWS, SALTS, hot_keys, join_hot
from ..scratch import materialise
from .textfold import shape_keys, skeleton_text


def canonical_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``canonical``: every text in its skeleton form; a null text stays null, a blank one becomes empty."""
    return df.select(F.col(id_col).alias("id"), skeleton_text(F.col(text_col)).alias("canonical"))


class Lookalikes:
    """Texts grouped by skeleton, and in it by written form; copies of a form are one row until pairs are listed."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS):
        self.hot_rows, self.salts = hot_rows, salts
        keys = df.select(F.col(id_col).alias("id"), shape_keys(F.col(text_col)).alias("k")).select("id", "k.skeleton", "k.form")
        #: ``id``, ``skeleton``, ``form`` (digests) of the texts that are not blank
        self.rows = materialise(keys.filter("skeleton is not null"), "shapes")
        #: ``skeleton``, ``form``, ``first_id``, ``n``: the classes; partial counts of a hot form move, not its rows
        self.forms = materialise(self.rows.groupBy("skeleton", "form").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "forms")

    def links(self) -> DataFrame:
        """``form_a`` < ``form_b`` of equal skeleton."""
        several = materialise(self.forms.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
        hot = hot_keys(several, ["skeleton"], hot_rows=self.hot_rows)
        some = join_hot(self.forms.select("skeleton", "form"), several.select("skeleton"), ["skeleton"], hot, self.salts)
        a, b = some.toDF("skeleton", "form_a"), some.toDF("skeleton", "form_b")
        return materialise(join_hot(a, b, ["skeleton"], hot, self.salts).filter("form_a < form_b").select("form_a", "form_b"), "links")

    def pairs(self) -> DataFrame:
        """``id_a`` < ``id_b``: every two texts of linked forms."""
        links = self.links()
        linked = links.select(F.col("form_a").alias("form")).union(links.select("form_b")).distinct()
        hot = hot_keys(self.forms, ["form"], hot_rows=self.hot_rows)
        part = materialise(join_hot(self.rows.select("id", "form"), linked, ["form"], hot, self.salts).select("id", "form"), "linked")
        half = join_hot(part.toDF("i", "form_a"), links, ["form_a"], hot, self.salts)
        both = join_hot(half, part.toDF("j", "form_b"), ["form_b"], hot, self.salts)
        return both.filter("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``id_a`` < ``id_b``: two texts of equal skeleton written with different characters.

    Spaces, tabs and line ends do not count; any other blank or invisible character does. Null and
    blank texts give no pair, nor does a table of none. Forms are joined, not texts: records of one
    form meet records of another form, never their own. A skeleton of ``hot_rows`` or more forms
    and a form of so many records are spread over ``salts`` tasks.
    """
    return Lookalikes(df, id_col, text_col, hot_rows, salts).pairs()
