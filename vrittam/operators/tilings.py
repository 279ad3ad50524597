"""All divisions of a weight string into feet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feet of the general metres beside the two kinds of the couplet, by weights.
GENERAL = {"UUU": "Ma", "IUU": "Ya", "UIU": "Ra", "IIU": "Sa", "UUI": "Ta", "IUI": "Ja", "UII": "Bha", "III": "Na", "UI": "Ha", "IU": "Va", "II": "La", "UU": "Ga", "IIII": "Nala", "IIIU": "Naga", "IIUI": "Sala"}
MOST = 50


def divisions(weights: str, feet: tuple[str, ...] = tuple(GENERAL), most: int = MOST) -> list[str]:
    """Divisions into feet, each joined by spaces, shorter first feet first, at most ``most``.

    A division is only begun if the rest can be divided, so the limit bounds the work.
    """
    order = sorted(feet, key=lambda f: (len(f), f))
    n = len(weights)
    can = [False] * n + [True]
    for at in range(n - 1, -1, -1):
        can[at] = any(weights.startswith(f, at) and can[at + len(f)] for f in order)
    out: list[str] = []
    # depth first with a stack of its own, so that a text may be of any length
    todo = [(0, ())] if n else []
    while todo and len(out) < most:
        at, so_far = todo.pop()
        if at == n:
            feet_, node = [], so_far
            while node:
                node, foot = node
                feet_.append(foot)
            out.append(" ".join(reversed(feet_)))
            continue
        todo += [(at + len(f), (so_far, f)) for f in reversed(order) if weights.startswith(f, at) and can[at + len(f)]]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_divisions(s: pd.Series) -> pd.Series:
    """:func:`divisions` of every weight string; equal strings are divided once per batch."""
    made = {w: divisions(w) for w in s.dropna().unique()}
    return s.map(lambda w: made.get(w, []))
