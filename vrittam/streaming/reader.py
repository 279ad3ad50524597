"""A reader of couplets that takes text in pieces of any size.

It keeps the settled weights of the current line and the tail of text whose weights may still
change: a syllable is settled once the one behind it is complete. Whether the line can still become
a valid one is a lookup among the beginnings of valid lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

from ..functions import alphabet as A

_SEP = re.escape("".join(A.SEPARATORS))
_SYLLABLE = re.compile(
    f"(?:[{A.CONSONANTS}](?:{A.VIRAMA}[{A.CONSONANTS}])*{A.VIRAMA}?[{A.SIGNS}{A.DIACRITICS}]*|[{A.VOWELS}][{A.DIACRITICS}]?|[^{_SEP}])"
    f"(?:[{A.CONSONANTS}]{A.VIRAMA}(?![{A.CONSONANTS}{A.SIGNS}{A.DIACRITICS}]))?|[{_SEP}]"
)
_HEAVY = re.compile(f"[{A.LONG_SIGNS}{A.DIPHTHONGS}{A.DIACRITICS}]|^[{A.LONG_VOWELS}]$|{A.VIRAMA}$")
_CLUSTER = re.compile(f"[{A.CONSONANTS}]{A.VIRAMA}[{A.CONSONANTS}]")
_RHYME = str.maketrans(A.RHYME_FROM, A.RHYME_TO)


@lru_cache(maxsize=1)
def tables() -> tuple[frozenset[str], frozenset[str]]:
    """Valid lines, and their beginnings."""
    full = frozenset(p for p, *_ in A.line_patterns())
    return full, frozenset(p[:k] for p in full for k in range(len(p) + 1))


@lru_cache(maxsize=1)
def third_places() -> dict[str, frozenset[int]]:
    """Beginning of a valid line to the places, from 0, at which its third foot may begin."""
    out: dict[str, set[int]] = {}
    for p, a, b, *_ in A.line_patterns():
        for k in range(len(p) + 1):
            out.setdefault(p[:k], set()).add(len(a) + len(b))
    return {k: frozenset(v) for k, v in out.items()}


def agree(a: str, b: str) -> bool:
    """Two letters are equal or of one class of alliteration."""
    return a == b or any(a in group and b in group for group in A.ALLITERATION)


class _Shapes(dict):
    """Translation table: a character to the first one of the same part in syllables and weights, others to ``x``."""

    def __init__(self) -> None:
        kinds = [re.compile(f"[{x}]") for x in (A.CONSONANTS, A.VIRAMA, A.SIGNS, A.DIACRITICS, A.VOWELS, A.LONG_SIGNS, A.DIPHTHONGS, A.LONG_VOWELS, _SEP, " ", "\n")]
        first: dict[tuple[bool, ...], str] = {}
        for c in map(chr, range(0x10000)):
            if any(kind := tuple(bool(k.match(c)) for k in kinds)):
                self[ord(c)] = first.setdefault(kind, c)

    def __missing__(self, cp: int) -> str:
        return "x"


@lru_cache(maxsize=1)
def _shapes() -> _Shapes:
    return _Shapes()


def shape(text: str) -> str:
    """A text with the same syllables and weights, equal for all texts whose letters are of the same kinds. Rhyme letters are lost."""
    return text.translate(_shapes())


@dataclass(frozen=True)
class VerseState:
    """A snapshot: everything the reader knows. Feeding returns a new one, so going back is keeping the old one."""

    settled: str = ""  # weights that cannot change any more, of the current line
    tail: str = ""  # text behind them
    seen: int = 0  # syllables of the line before the tail
    second: str = ""  # rhyme letter of the line's second syllable, once settled
    lines: tuple[str, ...] = ()  # weights of the finished lines
    rhymes: tuple[str, ...] = ()  # their rhyme letters
    firsts: str = ""  # first letters of the settled syllables of the current line

    def _weights(self, tail: str) -> tuple[list[str], list[str]]:
        """Syllables of the tail and their weights; a space ends the look-ahead."""
        parts = [x for x in _SYLLABLE.findall(tail) if x == " " or x not in A.SEPARATORS]
        syl, w = [], []
        for x, nxt in zip(parts, [*parts[1:], ""]):
            if x != " ":
                syl.append(x)
                w.append("U" if _HEAVY.search(x) or _CLUSTER.search(nxt) else "I")
        return syl, w

    def _feed_char(self, c: str) -> VerseState:
        if c == "\n":
            return self._end_line()
        tail = self.tail + c
        pieces = _SYLLABLE.findall(tail)
        state = replace(self, tail=tail)
        # the first syllable of the tail is settled when two syllables stand behind it
        starts = [k for k, x in enumerate(pieces) if x not in A.SEPARATORS]
        while len(starts) > 3:
            cut = starts[1]
            head, rest = "".join(pieces[:cut]), "".join(pieces[cut:])
            syl, w = state._weights(head + pieces[starts[1]] if " " not in pieces[starts[0] : cut] else head)
            state = state._settle(syl[0], w[0], rest)
            pieces = pieces[cut:]
            starts = [k for k, x in enumerate(pieces) if x not in A.SEPARATORS]
        return state

    def _settle(self, syllable: str, weight: str, rest: str) -> VerseState:
        second = self.second
        if self.seen == 1:
            second = syllable[0].translate(_RHYME) if syllable[0] in A.CONSONANTS else "-"
        return replace(self, settled=self.settled + weight, tail=rest, seen=self.seen + 1, second=second, firsts=self.firsts + syllable[0])

    def _end_line(self) -> VerseState:
        line = self.line()
        if not line:
            return replace(self, settled="", tail="", seen=0, second="", firsts="")
        state = self
        for s, w in zip(*self._weights(self.tail)):
            state = state._settle(s, w, "")
        return VerseState(lines=(*self.lines, line), rhymes=(*self.rhymes, state.second or "-"))

    def feed(self, text: str) -> VerseState:
        state = self
        for c in text:
            state = state._feed_char(c)
        return state

    def line(self) -> str:
        """Weights of the current line if it ended here."""
        return self.settled + "".join(self._weights(self.tail)[1])

    def alive(self) -> bool:
        """The current line can still become valid, and the rhyme letters agree so far."""
        begun = tables()[1]
        w = self._weights(self.tail)[1]
        known = self.settled + "".join(w[:-2])
        # the last syllable may grow or gain weight, the one before it may gain a final consonant
        ends = {x + y for x in {*w[-2:-1], "U"} for y in {*w[-1:], "U"}} if len(w) > 1 else ({*w, "U"} if w else {""})
        return any(known + e in begun for e in ends) and self.rhyme_alive()

    def rhyme_alive(self) -> bool:
        return not (self.rhymes and self.second) or self.second == self.rhymes[0] != "-"

    def yati_alive(self) -> bool:
        """The first letters of feet one and three agree, or may still: somewhere the third foot can begin there is one that does.

        The third foot begins at the places at which it does in the valid lines that go on from the
        settled weights; letters agree if they are equal or of one class of alliteration.
        """
        places = third_places().get(self.settled, frozenset())
        if not places or any(k >= len(self.firsts) for k in places):
            return True
        return any(agree(self.firsts[0], self.firsts[k]) for k in places)

    def accepts(self) -> bool:
        """The current line is a valid one."""
        return self.line() in tables()[0]

    def to_row(self) -> tuple:
        return (self.settled, self.tail, self.seen, self.second, "|".join(self.lines), "|".join(self.rhymes), self.firsts)

    @staticmethod
    def from_row(row: tuple) -> VerseState:
        settled, tail, seen, second, lines, rhymes, firsts = row
        split = lambda x: tuple(x.split("|")) if x else ()
        return VerseState(settled, tail, seen, second, split(lines), split(rhymes), firsts)
