"""Cleaning of the names that sources are given under."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_source(c: Column) -> Column:
    """Source in the spelling of the list of works: lower case, words joined by ``_``, no path or file ending.

    Null and blank sources become ``unknown``.
    """
    edge = r"[\s\x{a0}\x{2000}-\x{200b}/]+"
    name = F.regexp_replace(F.lower(c), f"^{edge}|{edge}$", "")
    name = F.regexp_replace(name, r"\.(txt|json|jsonl)$", "")
    name = F.regexp_replace(F.element_at(F.split(name, "/"), 1), r"[\s\x{a0}_-]+", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))
