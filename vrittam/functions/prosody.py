"""Syllables, weights, feet, rhyme and alliteration as column expressions that the optimiser can see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A



def strip(c: Column) -> Column:
    """Text without white space at its ends, as Python strips it."""
    return F.regexp_replace(c, f"^[{A.BLANKS}]+|[{A.BLANKS}]+$", "")


def lines(poem: Column) -> Column:
    """Stripped, non-blank lines of a text; null for a null text."""
    return F.filter(F.transform(F.split(poem, "\n"), strip), lambda x: x != "")


def normalised(poem: Column) -> Column:
    """Text with its lines stripped; blank lines inside stay, those at the ends go."""
    return strip(F.array_join(F.transform(F.split(poem, "\n"), strip), "\n"))


_C, _V, _M, _D, _H = A.span(A.CONSONANTS), A.span(A.VOWELS), A.span(A.SIGNS), A.span(A.DIACRITICS), A.VIRAMA
SYLLABLE = (
    f"(?:[{_C}](?:{_H}[{_C}])*+{_H}?+[{_M}{_D}]*+|[{_V}][{_D}]?+|[^{A.SEPARATOR_CLASS}])(?:[{_C}]{_H}(?![{_C}{_M}{_D}]))?+"
    f"|[{A.SEPARATOR_CLASS}]"
)
HEAVY = f"[{A.span(A.LONG_SIGNS + A.DIPHTHONGS + A.DIACRITICS)}]|^[{A.span(A.LONG_VOWELS)}]$|{_H}$"
CLUSTER = f"[{_C}]{_H}[{_C}]"


def syllables(line: Column) -> Column:
    """Syllables and separators of a line in order; a consonant without vowel belongs to the syllable before it."""
    return F.regexp_extract_all(line, F.lit(SYLLABLE), F.lit(0))


def _separator(x: Column) -> Column:
    return x.isin(*A.SEPARATORS)


def pure(syl: Column) -> Column:
    """Syllables without separators."""
    return F.filter(syl, lambda x: ~_separator(x))


def weighed(syl: Column, scope: str = "word") -> Column:
    """Syllables that :func:`weigh` needs: the pure ones and the separators at which looking ahead stops."""
    stops = STOPS[scope]
    return F.filter(syl, lambda x: x.isin(*stops) | ~_separator(x)) if stops else pure(syl)


STOPS = {"word": [" "], "line": [], "strict": [" ", "\n"]}


def weigh(kept: Column, scope: str = "word") -> Column:
    """Weights of the syllables of :func:`weighed` as a string of I and U.

    Give a column, not an expression: the array is read twice, as itself and moved by one.
    """
    stops = STOPS[scope]

    def weight(x: Column, after: Column) -> Column:
        w = F.when(x.rlike(HEAVY) | F.coalesce(after.rlike(CLUSTER), F.lit(False)), "U").otherwise("I")
        return F.when(x.isNull() | x.isin(*stops), "").otherwise(w) if stops else F.when(x.isNull(), "").otherwise(w)

    return F.array_join(F.zip_with(kept, F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(0))), weight), "")


def weights(syl: Column, scope: str = "word") -> Column:
    """Weights of the syllables as a string of I and U.

    A syllable is heavy by itself (long vowel, diphthong, nasal, breath, final consonant) or before a
    cluster. ``scope`` says how far that looks: ``word`` stops at a space, ``line`` does not,
    ``strict`` stops at a space and at a line end.
    """
    return weigh(weighed(syl, scope), scope)


def _in(patterns, text: str) -> str:
    return f"{text} IN ({', '.join(repr(p) for p in patterns)})"


def partition(gana: str) -> Column:
    """Best division of a weight string (given as SQL) into four feet: ``valid`` feet of the right kind, ``named`` ones, lengths ``a``, ``b``, ``c``, ``d``.

    The most valid feet win, then the first division in the order of :data:`alphabet.LENGTHS`. Null
    unless the line has 11 to 15 syllables. Valid lines have one division only.
    """
    combos = ", ".join(f"named_struct('o', {-k}, 'a', {a}, 'b', {b}, 'c', {c}, 'd', {d})" for k, (a, b, c, d) in enumerate(A.LENGTHS))
    at = {"a": "1", "b": "1 + x.a", "c": "1 + x.a + x.b", "d": "1 + x.a + x.b + x.c"}
    cut = {k: f"substring({gana}, {v}, x.{k})" for k, v in at.items()}
    valid = " + ".join(f"int({_in(A.SURYA if k == 'd' else A.INDRA, s)})" for k, s in cut.items())
    named = " + ".join(f"int({_in([*A.INDRA, *A.SURYA], s)})" for s in cut.values())
    return F.expr(f"array_max(transform(filter(array({combos}), x -> x.a + x.b + x.c + x.d = length({gana})), x -> named_struct('valid', {valid}, 'o', x.o, 'named', {named}, 'a', x.a, 'b', x.b, 'c', x.c, 'd', x.d)))")


def base_consonant(syllable: Column) -> Column:
    """First character of a syllable if it is a consonant."""
    c = F.substring(syllable, 1, 1)
    return F.when(c.isin(*A.CONSONANTS), c)


def rhyme_letter(consonant: Column) -> Column:
    """Consonant by its rhyme class."""
    return F.translate(consonant, A.RHYME_FROM, A.RHYME_TO)


def rhymes(syl1: Column, syl2: Column) -> Column:
    """Second syllables of two lines (pure syllables given) have equal or equivalent consonants; null if a line is too short."""
    a, b = base_consonant(F.get(syl1, F.lit(1))), base_consonant(F.get(syl2, F.lit(1)))
    short = (F.size(syl1) < 2) | (F.size(syl2) < 2)
    return F.when(~short, F.coalesce(rhyme_letter(a) == rhyme_letter(b), F.lit(False)))


def alliteration_class(letter: Column) -> Column:
    return F.translate(letter, *A.grouped(A.ALLITERATION, "a"))


def vowel(syllable: Column) -> Column:
    """Independent form of a syllable's vowel; a bare consonant has the inherent one."""
    sign = F.regexp_extract(syllable, f"[{A.SIGNS}]", 0)
    first = F.substring(syllable, 1, 1)
    return F.when(sign != "", F.translate(sign, A.SIGNS, A.SIGN_VOWELS)).when(first.isin(*A.VOWELS), first).otherwise("అ")


def consonants(syllable: Column) -> Column:
    return F.regexp_extract_all(syllable, F.lit(f"[{A.CONSONANTS}]"), F.lit(0))


def _bindu(x: Column, y: Column) -> Column:
    nasal = F.translate(base_consonant(x), "".join(A.NASALS), "".join(n * len(g) for g, n in A.NASALS.items()))
    classed = base_consonant(x).isin(*"".join(A.NASALS))
    return F.coalesce(F.contains(x, F.lit("ం")) & classed & (nasal == base_consonant(y)), F.lit(False))


def alliteration(x: Column, y: Column) -> Column:
    """How the first syllables of feet one and three agree: exact, varga_match, svara_yati, samyukta_yati, bindu_yati or no_match; null without one of them."""
    a, b = F.substring(x, 1, 1), F.substring(y, 1, 1)
    family = lambda s: F.translate(vowel(s), *A.grouped(A.VOWEL_FAMILIES, "a"))
    classes = lambda s: F.transform(consonants(s), alliteration_class)
    kind = (
        F.when(a == b, "exact")
        .when(alliteration_class(a) == alliteration_class(b), "varga_match")
        .when(family(x) == family(y), "svara_yati")
        .when(F.arrays_overlap(classes(x), classes(y)), "samyukta_yati")
        .when(_bindu(x, y) | _bindu(y, x), "bindu_yati")
        .otherwise("no_match")
    )
    return F.when(x.isNotNull() & y.isNotNull(), kind)
