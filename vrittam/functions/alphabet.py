"""Letters, feet and letter groups of the metres."""

from __future__ import annotations

from itertools import product

# The Telugu alphabet as the metres use it.
CONSONANTS = "కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరలవశషసహళఱ"
VOWELS = "అఆఇఈఉఊఋౠఎఏఐఒఓఔ"
SIGNS = "ాిీుూృౄెేైొోౌ"
SIGN_VOWELS = "ఆఇఈఉఊఋౠఎఏఐఒఓఔ"
LONG_SIGNS = "ాీూేోౌౄ"
LONG_VOWELS = "ఆఈఊౠఏఓ"
DIPHTHONGS = "ఐఔైౌ"
DIACRITICS = "ంః"
VIRAMA = "్"
SEPARATORS = [" ", "\n", "ఁ", "​", "‌", ",", "-", ")", "1", "4"]

# Feet by weights (I light, U heavy); the first kind fills three places, the second the last.
INDRA = {"IIII": "Nala", "IIIU": "Naga", "IIUI": "Sala", "UII": "Bha", "UIU": "Ra", "UUI": "Ta"}
SURYA = {"III": "Na", "UI": "Ha/Gala"}
# Feet of the Kannada ragale: any place in the analyser; in the automaton the last one is IIU.
RAGALE = ("III", "IIU", "UI")

# Letters that may stand for each other in alliteration, vowels of one family,
# consonants with the nasal of their class, and consonants equal in rhyme.
ALLITERATION = ("అఆఐఔహయ", "ఇఈఎఏఋ", "ఉఊఒఓ", "కఖగఘ", "చఛజఝశషస", "టఠడఢ", "తథదధ", "పఫబభవ", "రలఱళ", "నణ", "మ")
VOWEL_FAMILIES = ("అఆఐఔ", "ఇఈఎఏఋౠ", "ఉఊఒఓ")
NASALS = {"కఖగఘ": "ఙ", "చఛజఝ": "ఞ", "టఠడఢ": "ణ", "తథదధ": "న", "పఫబభ": "మ"}
RHYME_FROM, RHYME_TO = "ళసఱ", "లశర"
ARTICULATION = {"velar": "కఖగఘఙ", "palatal": "చఛజఝఞశషస", "retroflex": "టఠడఢణ", "dental": "తథదధన", "labial": "పఫబభమ", "approximant": "యరలవళఱ", "aspirate": "హ"}

#: Lengths of the four feet in the order they are tried.
LENGTHS = [(a, b, c, d) for a, b, c in product((3, 4), repeat=3) for d in (2, 3)]


def line_patterns() -> list[tuple[str, ...]]:
    """Every valid line: its weights and its four feet."""
    return [("".join(p), *p) for p in product(INDRA, INDRA, INDRA, SURYA)]


def grouped(groups: tuple[str, ...], first: str) -> tuple[str, str]:
    """Arguments of ``translate`` that send every letter of a group to the group's sign."""
    return "".join(groups), "".join(chr(ord(first) + k) * len(g) for k, g in enumerate(groups))


#: White space as Python strips it, as a regular-expression class for Spark and DuckDB alike.
BLANKS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATOR_CLASS = r" \nఁ\x{200b}\x{200c},)14\-"


def span(chars: str) -> str:
    """Inside of a regular-expression class for characters, neighbours joined to ranges: a class of ranges is tested much faster than one of single letters."""
    out, codes = [], sorted(map(ord, chars))
    while codes:
        k = 1
        while k < len(codes) and codes[k] == codes[0] + k:
            k += 1
        out.append(chr(codes[0]) + (f"-{chr(codes[k - 1])}" if k > 1 else ""))
        codes = codes[k:]
    return "".join(out)
