"""Folding of text to comparable forms.

``skeleton`` keeps every visible letter and mark but not the characters they are written with:
decompose, replace each character by the prototype of its shape, decompose again. The prototypes
are the public Unicode table of confusable characters, as the ICU library of Spark carries it.
``letters`` is the skeleton in lower case without punctuation and blanks.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File of the table of confusables in Spark's ICU library.
TABLE = "com/ibm/icu/impl/data/icudata/confusables.cfu"
#: Default-ignorable characters that are neither format nor control characters.
IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
#: Compatibility forms that only differ in width, font or position; raised, lowered, circled and square ones look different.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>")

def _library() -> str:
    import pyspark

    for folder in (os.path.join(os.environ.get("SPARK_HOME", ""), "jars"), os.path.join(os.path.dirname(pyspark.__file__), "jars")):
        found = sorted(glob.glob(os.path.join(folder, "icu4j-*.jar")))
        if found:
            return found[-1]
    raise FileNotFoundError("Spark's ICU library, which holds the table of confusables")


@lru_cache(maxsize=1)
def confusables() -> dict[int, str]:
    """Code point to prototype, of some 6,000 characters.

    The file holds, after its header, sorted keys (code point, and length of the prototype less
    one in the highest byte), a value for each (the prototype itself if it is one unit long, else its
    place among the strings) and the strings, all big-endian.
    """
    with zipfile.ZipFile(_library()) as z:
        raw = z.read(TABLE)
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    _, _, _, keys_at, n, values_at, _, strings_at, n_units = struct.unpack(">9i", body[:36])
    keys = struct.unpack(f">{n}I", body[keys_at : keys_at + 4 * n])
    values = struct.unpack(f">{n}H", body[values_at : values_at + 2 * n])
    units = body[strings_at : strings_at + 2 * n_units]
    out = {}
    for key, value in zip(keys, values):
        size = (key >> 24) + 1
        out[key & 0xFFFFFF] = chr(value) if size == 1 else units[2 * value : 2 * (value + size)].decode("utf-16-be", "surrogatepass")
    return out


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """The confusables but for letters said to look like several of their own script, as m like rn.

    Those are different letters, and texts that differ in them different texts. Characters of other
    scripts with the same prototype look like the letter and get it.
    """
    table = confusables()
    several = {cp: p for cp, p in table.items() if len(p) > 1 and unicodedata.category(chr(cp))[0] in "LM" and all(_script(x) == _script(chr(cp)) for x in p)}
    stand: dict[str, str] = {}
    for cp in sorted(several):
        stand.setdefault(several[cp], chr(cp))
    return {cp: stand.get(p, p) for cp, p in table.items()}


class _Shapes(dict):
    """Translation of letters, marks and digits to prototypes, made on demand; invisible characters to nothing, every blank to one space.

    Punctuation is left as it is: dashes and quotation marks of the table do not look the same.
    """

    def __missing__(self, cp: int) -> str | None:
        c = chr(cp)
        if c.isspace():
            out = " "
        elif unicodedata.category(c) in ("Cf", "Cc") or any(lo <= cp <= hi for lo, hi in IGNORABLE):
            out = None
        elif unicodedata.decomposition(c).startswith(SAME_LOOK):
            out = unicodedata.normalize("NFKD", c).translate(self)
        elif unicodedata.category(c)[0] in "LMN":
            out = prototypes().get(cp, c)
        else:
            out = c
        self[cp] = out
        return out


_SHAPES = _Shapes()


class _Folded(dict):
    """Forms of words, kept for a bounded number of them: texts of a corpus repeat their words."""

    KEPT = 300_000

    def __init__(self, form: Callable[[str], str]):
        super().__init__()
        self.form = form

    def __missing__(self, word: str) -> str:
        if len(self) >= self.KEPT:
            self.clear()
        out = self[word] = self.form(word)
        return out


_SKELETONS = _Folded(lambda w: unicodedata.normalize("NFD", unicodedata.normalize("NFD", w).translate(_SHAPES)))


def skeleton(text: str) -> str:
    """Shape-equal form of a text: letters, marks, digits and punctuation, blanks as single spaces."""
    return " ".join(w for w in map(_SKELETONS.__getitem__, text.split()) if w)


def tight_skeleton(text: str) -> str:
    """:func:`skeleton` without blanks."""
    return "".join(map(_SKELETONS.__getitem__, text.split()))


class _Letters(dict):
    """Translation table made on demand: case and shapes folded, all but letters, marks and digits a space."""

    def __missing__(self, cp: int) -> str | None:
        c = chr(cp)
        shape = _SHAPES[cp]
        if shape is None or shape == " ":
            out = shape
        elif unicodedata.category(c)[0] not in "LMN" and not any(unicodedata.category(x)[0] in "LMN" for x in unicodedata.normalize("NFKD", c)):
            out = " "
        else:
            # case first, so that a capital is the letter it is and not one that looks like it
            out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", c.lower()).translate(_SHAPES).lower())
        self[cp] = out
        return out


_LETTERS = _Letters()
_WORDS = _Folded(lambda w: unicodedata.normalize("NFD", w).translate(_LETTERS))


def folded_words(text: str) -> list[str]:
    """Words of a text in folded form: shapes, case and punctuation do not matter."""
    return " ".join(map(_WORDS.__getitem__, text.split())).split()


def letters(text: str) -> str:
    """Folded letters in their order, without blanks and punctuation."""
    return "".join(folded_words(text))


_ORDINARY = re.compile(r"[ \t\r\n]+")


def without_ordinary_space(text: str) -> str:
    """Text without spaces, tabs and line ends; other blanks stay."""
    return _ORDINARY.sub("", text)


def _digest(text: str) -> bytes | None:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if text else None


@F.pandas_udf(T.BinaryType())
def letters_key(s: pd.Series) -> pd.Series:
    """128-bit digest of :func:`letters`; null for a null text or one without letters."""
    return s.map(lambda x: None if x is None else _digest(letters(x)))


@F.pandas_udf(T.StructType().add("skeleton", T.BinaryType()).add("form", T.BinaryType()))
def shape_keys(s: pd.Series) -> pd.DataFrame:
    """Digests of the blank-free skeleton and of the text without ordinary white space; nulls for null and blank texts."""
    rows = []
    for x in s:
        t = "" if x is None else tight_skeleton(x)
        rows.append((_digest(t), _digest(without_ordinary_space(x))) if t else (None, None))
    return pd.DataFrame(rows, columns=["skeleton", "form"])


@F.pandas_udf(T.StringType())
def skeleton_text(s: pd.Series) -> pd.Series:
    """:func:`skeleton` as a column function; null stays null."""
    return s.map(lambda x: None if x is None else skeleton(x))
