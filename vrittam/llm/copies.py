"""Records that are equal but for how they are set down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hotkeys import HOT_ROWS, SALTS, apart, hot_keys
from ..scratch import materialise
from .textfold import letters_key


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key``: the digest of the folded letters, written once. Null and blank texts and texts without letters are left out."""
    keys = df.select(F.col(id_col).alias("id"), letters_key(F.col(text_col)).alias("key"))
    return materialise(keys, "letters").filter("key is not null")


def _split(keys: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary and of hot keys, the latter found by exact counts: partial counts move, not rows."""
    counts = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    return apart(keys, ["key"], hot_keys(counts, ["key"], hot_rows=hot_rows))


def _two_levels(hot: DataFrame, salts: int) -> DataFrame:
    """``key``, ``first_id``, ``copies`` of hot keys, by key and salt and then by key."""
    salted = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("i"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("key").agg(F.min("i").alias("first_id"), F.sum("n").alias("copies"))


def copy_groups(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``first_id`` (smallest identifier), ``copies``.

    Texts are equal when their letters are, apart from blanks, punctuation, case and look-alike
    characters. Hot keys go through two levels (key and salt, then key), the others through one.
    Null and blank texts form no group; an empty table gives no rows. Identifiers may be of any
    ordered type.
    """
    cold, hot = _split(keyed(df, id_col, text_col), hot_rows)
    one = cold.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    out = one if hot is None else one.unionByName(_two_levels(hot, salts))
    return out.select("first_id", "copies")


def copies_found(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``first_id``, ``id`` of every record that is a copy of a record with a smaller identifier.

    The identifiers of an ordinary group (fewer than ``hot_rows``) are gathered with its minimum, so
    one shuffle does. Rows of hot groups stay where they are and get their representative by a
    broadcast of the two-level results, one row for each of the bounded number of hot keys.
    """
    cold, hot = _split(keyed(df, id_col, text_col), hot_rows)
    one = (
        cold.groupBy("key")
        .agg(F.min("id").alias("first_id"), F.collect_list("id").alias("ids"))
        .filter(F.size("ids") > 1)
        .select("first_id", F.explode("ids").alias("id"))
    )
    if hot is not None:
        one = one.unionByName(hot.join(F.broadcast(_two_levels(hot, salts)), "key").select("first_id", "id"))
    return one.filter("id > first_id")
