"""Broken prompt and response pairs: empty, refusing, copied, truncated answers, and verse in another language.

The languages of prompt and answer are compared by posteriors of a character n-gram naive Bayes,
truncation is seen at incomplete verse and at text ends that an end-of-text n-gram model finds
unlikely. Both models are fitted on a bounded sample of the table itself.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngrams import EndModel, NgramBayes

#: Rows the two models are fitted on, at most.
FIT_ROWS = 3000
#: Share of an answer's n-grams found in its prompt from which the answer is a copy.
COPIED = 0.72
DEFECTS = ("empty", "refusal", "copy", "truncated", "language")

# Words of labels and placeholders, which say nothing by themselves.
LABEL_WORDS = set("poem answer model user assistant note response output couplet verse ragale dvipada question system bot ai ద్విపద పద్యం పద్యము రగళె సమాధానం జవాబు ప్రశ్న ರಗಳೆ ಪದ್ಯ ಉತ್ತರ ಪ್ರಶ್ನೆ".split())
PLACEHOLDERS = set("null none nan na n a nil empty undefined error tbd".split())
# Phrases of inability, English, Telugu, Kannada and romanised Telugu.
REFUSALS = re.compile(
    r"\b(?:unable to|can(?:no|')t (?:help|write|do|assist|compose|produce|fulfil|create|provide)|can not|won'?t be able|not able to|must decline|have to decline|decline to|i refuse|"
    r"pass on this|not a form i know|beyond what i can|do(?:n't| not) know how to|outside (?:of )?my (?:scope|ability)|not (?:allowed|permitted) to|not something i can)"
    r"|సాధ్యం కాదు|సాధ్యపడదు|[ఀ-౿]లేను(?![ఀ-౿])|నావల్ల కాదు|నా వల్ల కాదు|నాకు రాదు|నాకు చేతకాదు|అనుమతి లేదు|పరిధిలో లేదు|కుదరదు|వీలు కాదు|వీలుకాదు"
    r"|ಸಾಧ್ಯವಿಲ್ಲ|ಸಾಧ್ಯವಾಗುವುದಿಲ್ಲ|[ಀ-೿]ಲಾರೆ(?![ಀ-೿])|ಆಗುವುದಿಲ್ಲ|ಆಗದು|ಅನುಮತಿ ಇಲ್ಲ|ಅನುಮತಿಯಿಲ್ಲ|ಬರುವುದಿಲ್ಲ|ವ್ಯಾಪ್ತಿಯಲ್ಲಿಲ್ಲ|ವ್ಯಾಪ್ತಿಯಲ್ಲಿ ಇಲ್ಲ"
    r"|\bsaadhyam kaadu|[a-z]+a?lenu\b|naa ?valla kaadu|naaku raadu|anumati ledu|paridhilo ledu",
    re.IGNORECASE,
)
PROSE_LABEL = re.compile(r"^(?:భావం|భావము|తాత్పర్యం|అర్థం|వివరణ|ಭಾವ|ಭಾವಾರ್ಥ|ಅರ್ಥ|ತಾತ್ಪರ್ಯ|meaning|explanation|gloss)\s*[:：\-–]", re.IGNORECASE)
#: Roman letters of the Telugu letters, for the model of romanised Telugu.
ROMAN_CONSONANTS = dict(zip("కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహ", "k kh g gh n c ch j jh n t th d dh n t th d dh n p ph b bh m y r r l l v s sh s h".split(), strict=True))
ROMAN_VOWELS = dict(zip("అఆఇఈఉఊఋఎఏఐఒఓఔ", "a aa i ii u uu ri e ee ai o oo au".split(), strict=True)) | dict(zip("ాిీుూృెేైొోౌ", "aa i ii u uu ri e ee ai o oo au".split(), strict=True)) | {"ం": "m", "ః": "h"}
VIRAMA = "్"

# feet of a verse line by weights (I light, U heavy): three of the first kind and one of the second
FEET = ("IIII", "IIIU", "IIUI", "UII", "UIU", "UUI")
LAST_FEET = ("III", "UI")

_MARKUP = re.compile(r"<[^<>\n]{1,40}>(?:model|user|assistant)?|\*\*|^#+|^>+", re.MULTILINE)
_SYLLABLE = re.compile(r"[క-హౘ-ౚ](?:్[క-హౘ-ౚ])*(?:్(?![క-హ]))?[ా-ౌౕౖ]*[ఀ-ః]*|[అ-ఔౠౡ][ఀ-ః]*")
_DOUBLE = re.compile("[క-హ]్[క-హ]")
_LINE_SIGNS = re.compile(r"\s*[/|।॥]\s*|\s{3,}")
_INNER_STOP = re.compile(r"[.?!]\s+\S*\w")
_SENTENCE = re.compile(r"([^.?!।॥]+[.?!।॥])(?=\s*[^\s.?!।॥])")
_ANY_STOP = re.compile(r"[.?!:]")
_CLOSING = re.compile(r"[\s\"'”’»)\]*_]+$")
#: format characters of the plain planes; joiners, marks of direction, the byte order mark
_FORMAT = re.compile("[\u00ad\u0600-\u0605\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_HEAVY = re.compile(r"[ాీూేైోౌౄౖంః]|^[ఆఈఊఏఐఓఔౠ]|్$")


class _Scripts(dict):
    """Script of a letter or mark by its Unicode name; te and kn for short, nothing for other characters; filled as characters come."""

    def __missing__(self, c: str) -> str:
        out = ""
        if unicodedata.category(c)[0] in "LM":
            name = unicodedata.name(c, "").split(" ")[0].lower()
            out = {"telugu": "te", "kannada": "kn", "combining": ""}.get(name, name)
        self[c] = out
        return out


_SCRIPTS = _Scripts()


class _Said(dict):
    """Translation of all but letters, marks and digits to blanks, and of format characters to nothing; made on demand."""

    def __missing__(self, cp: int) -> str:
        kind = unicodedata.category(chr(cp))
        out = self[cp] = chr(cp) if kind[0] in "LMN" else "" if kind == "Cf" else " "
        return out


_SAID = _Said()
_TELUGU = {cp: cp - 0x80 for cp in range(0xC80, 0xD00)}


def script_of(text: str) -> str:
    """The script of all letters: te, kn, latin, ..., or nothing for several or none."""
    seen = {_SCRIPTS[c] for c in set(text)} - {""}
    return seen.pop() if len(seen) == 1 else ""


def words(text: str) -> list[str]:
    return text.translate(_SAID).split()


def romanise(text: str) -> str:
    """Plain roman spelling of Telugu text."""
    out = []
    for i, c in enumerate(text):
        if c in ROMAN_CONSONANTS:
            nxt = text[i + 1 : i + 2]
            out.append(ROMAN_CONSONANTS[c] + ("" if nxt == VIRAMA or (nxt in ROMAN_VOWELS and unicodedata.category(nxt)[0] == "M" and nxt not in "ంః") else "a"))
        elif c != VIRAMA:
            out.append(ROMAN_VOWELS.get(c, c))
    return "".join(out)


@lru_cache(maxsize=50_000)
def foot_of(word: str) -> str:
    """Weights of the syllables of a Telugu or Kannada word, written I and U."""
    s = _SYLLABLE.findall(word.translate(_TELUGU))
    return "".join("U" if _HEAVY.search(a) or _DOUBLE.match(b) else "I" for a, b in zip(s, [*s[1:], ""]))


def line_tokens(words_: list[str], language: str) -> list[str]:
    """A verse line for the end model: number of words, number of syllables, weights of the last word (the last three of a long one).

    In scripts whose weights are not known: the number of words.
    """
    if not words_:
        return []
    if language in ("te", "kn"):
        last = foot_of(words_[-1])
        return [f"{len(words_)} words", f"{sum(len(foot_of(w)) for w in words_)} syllables", last if len(last) < 5 else "-" + last[-3:]]
    return [f"{len(words_)} words"]


def prose_tokens(text: str) -> list[str]:
    """The last characters of a run of prose for the end model, the very last by its kind if it is a mark; closing quotes and brackets do not count."""
    t = _CLOSING.sub("", text)
    return [*t[-4:-1], t[-1] if _SAID[ord(t[-1])] != " " else "stop" if t[-1] in ".?!।॥" else "mark"] if t else []


class _Prompt:
    """What a prompt asks for, made once for all its answers."""

    def __init__(self, judge: Judge, prompt: str):
        w = words(prompt)
        self.grams = set(_grams(" ".join(w)))
        best = judge.languages.best(w)
        if best in ("en", "te-Latn"):
            best = "kn" if re.search(r"kannada|ragale", prompt, re.IGNORECASE) else "te"
        self.want = best if best in ("te", "kn") else script_of(prompt) or "te"


class Judge:
    """Decides the defect of one answer with the two fitted models."""

    def __init__(self, languages: NgramBayes, lines: EndModel, prose: EndModel):
        self.languages, self.lines, self.prose = languages, lines, prose
        self._prompts: dict[str, _Prompt] = {}

    def prompt(self, text: str) -> _Prompt:
        got = self._prompts.get(text)
        if got is None:
            if len(self._prompts) >= 20_000:
                self._prompts.clear()
            got = self._prompts[text] = _Prompt(self, text)
        return got

    def ended(self, text: str) -> bool:
        """A run of prose is complete: texts end so more often than they are cut so."""
        return self.prose.log_odds(prose_tokens(text)) > 0

    def whole(self, words_: list[str], language: str) -> bool:
        """A verse line is complete: lines end so more often than they are cut so."""
        return self.lines.log_odds(line_tokens(words_, language)) > 0

    def defect(self, prompt: str | None, raw: str | None) -> str | None:
        text = _MARKUP.sub(" ", _FORMAT.sub("", raw or "").replace("\r", "\n"))
        lines = [x for x in (y.strip() for y in text.split("\n")) if x]
        said = words(text)
        if not any(map(_tells, said)) and "\ufffd" not in text:
            return "empty"
        asked = self.prompt(prompt or "")
        refuses = bool(REFUSALS.search(text))
        units = []  # (text, language or None for what is no verse, complete)
        for line in lines:
            units += self._parts(line, asked.grams, refuses)
        at = next((i for i in range(len(units) - 1) if units[i][1] == units[i + 1][1] == asked.want and units[i][2] and units[i + 1][2]), None)
        if at is not None:
            return self._after(units, at + 2)
        if refuses:
            return "refusal"
        if _copied(list(filter(_tells, said)), asked.grams):
            return "copy"
        return self._other(lines, units, asked.want)

    def _parts(self, line: str, p_grams: set[str], refuses: bool) -> list[tuple[str, str | None, bool]]:
        """(text, language or None, complete) of the verse lines written in one line of text, or of its prose."""
        body = line.strip("\"'“”‘’«»[]() ")
        out = []
        pieces = [(x, w) for x in _LINE_SIGNS.split(body) if (w := words(x))]
        if len(pieces) > 1 and not all(2 < len(w) < 7 for _, w in pieces):
            pieces = [(body, words(body))]
        for piece, w in pieces:
            if all(x.lower() in LABEL_WORDS for x in w):
                continue
            if len(w) > 8:
                out.append((piece, None, False))
                continue
            language = self.languages.best(w)
            feet = [foot_of(x) for x in w] if language in ("te", "kn") else []
            metrical = len(feet) == 4 and all(f in FEET for f in feet[:3]) and feet[3] in LAST_FEET
            stop = piece.rstrip().endswith(".")
            if (
                language in ("en", "te-Latn")
                or (len(w) != 4 and stop)
                or (piece.rstrip().endswith(":") and not metrical)
                or PROSE_LABEL.match(piece)
                or _INNER_STOP.search(piece)
                or (refuses and REFUSALS.search(piece))
                or _copied(w, p_grams)
            ):
                out.append((piece, None, False))
                continue
            clean = "\ufffd" not in piece
            if not feet:
                out.append((piece, language if 3 <= len(w) <= 6 else None, clean and self.whole(w, language)))
                continue
            good = sum(f in FEET or f in LAST_FEET for f in feet)
            if len(w) in (7, 8) and sum(map(len, feet)) >= 20 and good >= 6:  # both lines in one
                out += [(" ".join(w[:4]), language, True), (" ".join(w[4:]), language, clean and self.whole(w[4:], language))]
                continue
            whole = clean and self.whole(w, language)
            out.append((piece, language if whole or good * 2 >= len(feet) else None, whole))
        return out

    def _after(self, units: list, start: int) -> str | None:
        """Text behind a complete couplet: complete verse and ended prose are no defect."""
        rest = units[start:]
        if not rest:
            return None
        text, language, whole = rest[-1]
        if language and not (text.rstrip().endswith(".") and len(rest) == 1):
            return None if whole and len([u for u in rest if u[1]]) % 2 == 0 else "truncated"
        return None if self.ended(text) else "truncated"

    def _other(self, lines: list[str], units: list, want: str) -> str:
        """No couplet in the language asked for: complete verse in another language, or an answer broken off."""
        for i in range(len(units) - 1):
            if units[i][1] and units[i][1] == units[i + 1][1] != want and units[i][2] and units[i + 1][2]:
                return self._after(units, i + 2) or "language"
        foreign = [x for x in lines if not x.endswith(":") and len(words(x)) > 2 and self.languages.best(words(x)) in ("en", "te-Latn")]
        if len(foreign) >= 2:
            last = lines[-1]
            if self.ended(last) or (self.languages.best(words(last)) == "te-Latn" and len(words(last)) >= 4):
                return "language"
        return "truncated"


def _tells(word: str) -> bool:
    """A word that is no label and no placeholder."""
    low = word.lower()
    return low not in LABEL_WORDS and low not in PLACEHOLDERS


def _grams(text: str) -> list[str]:
    t = f" {text.lower()} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def _copied(words_: list[str], p_grams: set[str]) -> bool:
    """At least :data:`COPIED` of the n-grams of the words are in the prompt."""
    g = _grams(" ".join(words_)) if p_grams and words_ else ()
    left = len(g) - COPIED * len(g)
    for x in g:
        if x not in p_grams:
            left -= 1
            if left < 0:
                return False
    return bool(g)


def _cuts(text: str, n: int) -> list[str]:
    """``n`` beginnings of a text, cut at places that depend on it only."""
    return [text[: 1 + zlib.crc32(f"{k}{text}".encode("utf-8", "surrogatepass")) % (len(text) - 1)] for k in range(n)] if len(text) > 1 else []


def fit(rows: list[tuple[str | None, str | None]]) -> Judge:
    """Models from (prompt, answer) rows.

    Lines in one script label themselves for the language model; romanised Telugu is made from the
    Telugu lines. A verse line before another line is complete, and so is a sentence before another
    sentence; the end models compare both with the same texts cut at random places.
    """
    languages, verse, prose = NgramBayes(2), EndModel(), EndModel()
    for prompt, raw in rows:
        for text in (prompt, raw):
            for line in (text or "").split("\n"):
                w, script = words(line), script_of(line)
                if len(w) < 3 or not script:
                    continue
                languages.add("en" if script == "latin" else script, w)
                if script == "te":
                    languages.add("te-Latn", [romanise(x) for x in w])
        lines = [x for x in (y.strip() for y in _FORMAT.sub("", raw or "").replace("\r", "\n").split("\n")) if x]
        for line in lines[:-1]:
            w, script = words(line), script_of(line)
            if 3 <= len(w) <= 6 and script not in ("", "latin") and not _ANY_STOP.search(line):
                # as it stands, and with any two words run together
                for said in (line, *(" ".join([*w[:k], w[k] + w[k + 1], *w[k + 2 :]]) for k in range(len(w) - 1))):
                    verse.add(line_tokens(words(said), script), True)
                    for cut in _cuts(said, 3):
                        verse.add(line_tokens(words(cut), script), False)
        for line in lines:
            # a sentence before another one is complete
            for m in _SENTENCE.finditer(line):
                if len(words(m.group())) >= 4:
                    prose.add(prose_tokens(m.group(1)), True)
                    for cut in _cuts(m.group(1), 6):
                        prose.add(prose_tokens(cut), False)
    return Judge(languages, verse, prose)


def broken_answers(df: DataFrame, id_col: str, prompt_col: str, answer_col: str, extract_col: str | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id``, ``defect`` of every defective answer, the first fitting of :data:`DEFECTS`.

    An answer that holds a complete couplet in the language asked for is defective only if text
    behind it breaks off. A null or blank answer is judged by its extract, if there is one, and is
    empty otherwise; a null prompt asks for Telugu. The models see ``fit_rows`` rows chosen by hash;
    the decision is made for all rows in one narrow pass. An empty table gives no rows.
    """
    spark = df.sparkSession
    answer = F.col(answer_col)
    if extract_col:
        answer = F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", F.col(extract_col)).otherwise(answer)
    rows = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), answer.alias("answer"))
    sample = rows.filter(F.col("prompt").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    shared = spark.sparkContext.broadcast(fit([(r[1], r[2]) for r in sample.collect()]))

    @F.pandas_udf(T.StringType())
    def decide(prompt: pd.Series, raw: pd.Series) -> pd.Series:
        j = shared.value
        return pd.Series([j.defect(p, r) for p, r in zip(prompt, raw)], dtype=object)

    return rows.select("id", decide("prompt", "answer").alias("defect")).filter(F.col("defect").isNotNull())
