"""Couplets quoted in texts."""

from __future__ import annotations

import re
import unicodedata

# Words that end the label before a quoted couplet, labels of text that is no verse,
# and words with which a sentence goes on behind a quoted couplet.
VERSE_LABELS = ("పద్యం", "ద్విపద", "పద్యము", "రగళె", "poem", "couplet", "verse", "ಪದ್ಯ", "ರಗಳೆ")
PROSE_LABELS = ("భావం", "తాత్పర్యం", "అర్థం", "ముగింపు", "line_1", "line_2", "meaning", "gloss", "ಭಾವ", "ಭಾವಾರ್ಥ")
SENTENCE_AFTER = (" అను పద్య", " అనే పద్య", " అను ద్విపద", " అనే ద్విపద")

_LABEL = re.compile(r"^[\s*#>•\-–—\"“‘']*([^\s:]+(?: [^\s:]+){0,3}?)\**\s*:\**\s*")
_LINE_END = re.compile(r"\r\n|[\n\r]")
# ends of a verse line inside a line of text
_VERSE_END = re.compile(r"\s*[/।॥|;]\s*|\s{2,}|(?<=,)\s+")


def _key(text: str) -> str:
    """Letters, marks and digits of a text as they are."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c)[0] in "LMN")


def quoted_couplets(text: str | None) -> list[str]:
    """Letters of each couplet that a text quotes, first line and second line joined.

    Text without a label is verse until a label of prose; each label of verse begins a new quote. In
    a quote every two lines are a couplet, however they are parted (line end, slash, danda,
    semicolon, a run of blanks); one line of six or more words is both lines run together. A
    single half is no couplet. Lines behind a complete couplet that form none with it are left out.
    """
    if not text:
        return []
    out: list[str] = []
    verse: list[str] = []
    open_verse = True

    def close() -> None:
        lines = [(k, len(v.split())) for v in verse if (k := _key(v))]
        if len(lines) == 1 and lines[0][1] >= 6:
            out.append(lines[0][0])
        at = 0
        while at + 1 < len(lines):
            # a line that holds a whole couplet stands for itself
            if lines[at][1] >= 7:
                out.append(lines[at][0])
                at += 1
            else:
                out.append(lines[at][0] + lines[at + 1][0])
                at += 2
        verse.clear()

    for line in _LINE_END.split(text):
        m = _LABEL.match(line)
        if m:
            label = m.group(1).strip("*#\"“”‘’' ").lower()
            if label.startswith(PROSE_LABELS):
                close()
                open_verse = False
                continue
            close()
            open_verse = label.endswith(VERSE_LABELS)
            line = line[m.end() :]
        if not open_verse:
            continue
        cut = min((p for s in SENTENCE_AFTER if (p := line.find(s)) >= 0), default=-1)
        verse.extend(_VERSE_END.split(line[:cut] if cut >= 0 else line))
        if cut >= 0:
            close()
            open_verse = False
    close()
    return out
