"""Cleaning of lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import BLANKS
from .prosody import strip

# The characters that cleaning deletes.
REMOVED = "'‘’\"“”„`´«»,?!–—ఁ ;:.()[]"

# Settings of the sources: characters deleted besides, trailing digits deleted, lines parted at hyphens.
SOURCES = {"basava": ("", False, True), "palanati": ("", True, False), "bhagavatam": ("", True, False), "srirama": ("-", False, False)}


def clean_line(line: Column, extra: str = "", trailing_digits: bool = False) -> Column:
    """Line without the removed characters (a line that begins with ``#`` keeps its colons), runs of spaces and blank ends.

    ``trailing_digits`` also deletes digits at the end of a line that is no ``#`` line. Null stays null.
    """
    head = F.startswith(line, F.lit("#"))
    text = F.when(head, F.translate(line, REMOVED.replace(":", "") + extra, "")).otherwise(F.translate(line, REMOVED + extra, ""))
    if trailing_digits:
        text = F.when(head, text).otherwise(F.regexp_replace(text, f"[0-9]+[{BLANKS}]*$", ""))
    return strip(F.regexp_replace(text, "  +", " "))


def dedup_key(text: Column) -> Column:
    """Text without line ends, spaces and punctuation: equal for near-equal poems."""
    return F.translate(text, "\n ,.-;:!?()\"'।॥", "")


def squeezed(text: Column) -> Column:
    """Crawled text: bracketed numbers, trailing line numbers and hyphenation removed, at most one blank line in a row."""
    t = F.regexp_replace(text, r"\[[0-9]+\]", "")
    t = F.regexp_replace(t, r"(?m)[ \t]*[0-9]+[ \t]*$", "")
    t = F.regexp_replace(t, r"-\n", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def file_name(name: Column, longest: int = 50) -> Column:
    """Name without characters that file systems refuse, blanks as underscores, at most ``longest`` characters."""
    return F.substring(F.regexp_replace(strip(F.regexp_replace(name, r'[<>:"/\\|?*]', "")), f"[{BLANKS}]+", "_"), 1, longest)


def clean_text(text: Column, extra: str = "", trailing_digits: bool = False, part_hyphens: bool = False) -> Column:
    """``text``, ``lines`` and ``removed`` (characters less than before) of a whole text cleaned line by line.

    With ``part_hyphens`` a line with hyphens that is no ``#`` line becomes several, empty ones left out;
    other empty lines stay. Null stays null.
    """

    def parted(c: Column, line: Column) -> Column:
        pieces = F.filter(F.transform(F.split(c, "-"), strip), lambda x: x != "")
        return F.when(~F.startswith(line, F.lit("#")) & F.contains(c, F.lit("-")), pieces).otherwise(F.array(c))

    def one(line: Column) -> Column:
        cleaned = clean_line(line, extra, trailing_digits)
        # bound by a lambda, so that the line is cleaned once
        return F.flatten(F.transform(F.array(cleaned), lambda c: parted(c, line)))

    before = F.split(text, "\n")
    after = F.flatten(F.transform(before, one)) if part_hyphens else F.transform(before, lambda x: clean_line(x, extra, trailing_digits))
    made = F.transform(F.array(F.array_join(after, "\n")), lambda t: F.struct(t.alias("text"), F.size(before).alias("lines"), (F.length(text) - F.length(t)).alias("removed")))
    return F.when(text.isNotNull(), F.get(made, F.lit(0)))
