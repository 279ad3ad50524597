"""Transliteration between Telugu and Kannada and its quality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Telugu letters, signs and digits that have a Kannada counterpart at the same place of its block.
TELUGU = "అఆఇఈఉఊఋౠఌఎఏఐఒఓఔకఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహఽాిీుూృౄెేైొోౌంఃఁ్౦౧౨౩౪౫౬౭౮౯"
KANNADA = "".join(chr(ord(c) + 0x80) for c in TELUGU)


def telugu_to_kannada(text: Column) -> Column:
    """Kannada spelling; characters without a counterpart stay."""
    return F.translate(text, TELUGU, KANNADA)


def kannada_to_telugu(text: Column) -> Column:
    return F.translate(text, KANNADA, TELUGU)


def count_in(text: Column, span: str) -> Column:
    """Number of characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{span}]", ""))


def quality(text: Column) -> Column:
    """Expected accuracy of a transliteration: 0.99 for plain letters, 0.85 for signs, 0.70 for clusters, weighted by their number; null without any."""
    plain = count_in(text, r"\x{0C05}-\x{0C39}")
    sign = count_in(text, r"\x{0C3E}-\x{0C4C}\x{0C02}\x{0C03}")
    cluster = count_in(text, r"\x{0C4D}")
    n = plain + sign + cluster
    return F.when(n > 0, (plain * 0.99 + sign * 0.85 + cluster * 0.70) / n)


def converted_map(m: Column) -> Column:
    """Map with keys and values in Kannada spelling; of keys that become equal the last stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(telugu_to_kannada(e["key"]).alias("key"), telugu_to_kannada(e["value"]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda z: z["key"] == e["key"]))
    return F.map_from_entries(last)
