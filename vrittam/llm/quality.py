"""Per-document text statistics, and whether a document is connected language.

Boosted trees on the statistics are fitted on weakly labelled prose, verse and structural junk of a
bounded sample; their probabilities are calibrated on a small hand-checked set. Every document is
measured over its whole text and judged in one narrow pass.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boost import BoostedTrees
from .holdout import HOLDOUT

#: Documents whose statistics the trees are fitted on, at most.
FIT_ROWS = 4000

# Function words of Telugu, Kannada, English and romanised Telugu.
COMMON_WORDS = frozenset(
    (
        "మరియు ఆ ఈ ఒక అని కూడా తన వారు అతడు ఆమె ఇది అది కాని లేదా వలె కోసం గురించి వరకు నుండి మీద కింద ఎంతో అప్పుడు చాలా అక్కడ మళ్ళీ ఇప్పుడు ఇక్కడ ప్రతి అన్ని తరువాత వద్ద మాత్రమే ముందు అయితే అందుకే అనే వంటి నేను నీవు మీరు మనం వాడు ఏమి ఎవరు ఎలా ఎందుకు కాదు లేదు ఉంది "
        "ಮತ್ತು ಆ ಈ ಒಂದು ಎಂದು ಕೂಡ ತನ್ನ ಅವರು ಇದು ಅವಳು ಅವನು ಆದರೆ ಅಥವಾ ಅದು ಬಗ್ಗೆ ಮೇಲೆ ಇಂದ ಹಾಗೆ ತುಂಬಾ ಮತ್ತೆ ಕೆಳಗೆ ತನಕ ಈಗ ನಂತರ ಆಗ ಅಲ್ಲಿ ಇಲ್ಲಿ ಪ್ರತಿ ಎಲ್ಲಾ ಮುಂದೆ ನಾನು ನೀನು ನಾವು ಏನು ಯಾರು ಇಲ್ಲ "
        "the of and a to in is that it was for on as with by at be from this or which an are not they his but its their then over when under into through her have has had he she you we i if so there were will would can all one "
        "mariyu ā ī oka ani kūḍā tana vāru ataḍu āme idi adi kāni lēdā vale kōsaṁ guriṁci varaku nuṁḍi mīda kiṁda eṁtō appuḍu cālā akkaḍa maḷḷī ippuḍu ikkaḍa prati anni taruvāta vadda mātramē muṁdu ayitē aṁdukē anē vaṁṭi"
    ).split()
)

STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "line_end_punctuation", "common_word_share")
FEATURES = (*STATISTICS, "digit_ratio", "separator_ratio", "letter_ratio", "replacement_ratio", "words_per_line", "short_line_share", "verse_line_share", "list_line_share", "unique_word_share", "top_word_share", "repeated_line_share", "long_word_share", "squeeze", "comma_share", "tag_ratio", "stray_mark_share", "sentences_per_word", "letter_word_share", "pair_line_share", "verb_share", "hundred_characters")

_DIGITS = re.compile(r"[0-9౦-౯೦-೯]")
_PLAIN = frozenset(".,?!;:'\"“”‘’()।॥-–—…")
_SEPARATOR_SIGNS = frozenset("|\t·»;=<>/\\")
_SEPARATORS = re.compile(r"[|\t·»;=<>/\\]")


class _Kinds(dict):
    """Kind of a character: letter, mark, digit, blank, plain punctuation, other; filled as characters come."""

    def __missing__(self, c: str) -> str:
        if c.isspace():
            kind = "blank"
        elif _DIGITS.match(c):
            kind = "digit"
        elif c in _PLAIN:
            kind = "plain"
        else:
            kind = {"L": "letter", "M": "mark"}.get(unicodedata.category(c)[0], "other")
        self[c] = kind
        return kind


_KINDS = _Kinds()
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_LINE_END = re.compile(r"[.?!।॥…,;:][\"'”’»)\]]*$")
_QUOTES, _STOPS = "\"'”’)]»", frozenset(".?!।")
_BULLET = re.compile(r"(?:[-–—+*•·◦▪>]|\(?[0-9a-zA-Z]{1,3}[.)]|[ivx]{1,4}\.|\[\d+\])\s")
_PAIR = re.compile(r"\S\s+(?::|=|->|–|—|-)\s+\S|\.{3,}\s*\d+$")
# endings of finite verbs
_VERB_ENDS = tuple("ెను ాడు ింది ారు ాయి ున్నది ేను ండి ుంది ెద ను ది ದನು ದಳು ದರು ಿತು ತ್ತು ದೆ".split())
_HEAD = re.compile(r"\s*#[^\n\r]*:[^\n\r]*(?:\r\n|[\n\r]|$)|\s*[^\n\r.?!|\t]{1,40}(?:\r\n|[\n\r])\s*(?:\r\n|[\n\r])(?=\s*\S)")
_STRAY = re.compile("(?<=\ufffd)[ా-్ಾ-್]")
_WORD_EDGE = ".,?!;:'\"“”‘’()।॥-–—…*[]{}«»"


# blanks and characters that show nothing
_NOTHING = "".join(c for c in map(chr, range(0x10000)) if c.isspace() or unicodedata.category(c) in ("Cf", "Cc")) + "\u034f\ufe0f"


def blank(text: str | None) -> bool:
    """Null, empty, or of blanks and invisible characters only."""
    return not (text and text.strip(_NOTHING))


def body(text: str) -> str:
    """Text without headings at its beginning: ``# key: value`` lines and a first line of up to three words parted by an empty line."""
    at = 0
    while (m := _HEAD.match(text, at)) and len(m.group().split()) <= (12 if m.group().lstrip().startswith("#") else 3):
        at = m.end()
    rest = text[at:]
    return text if blank(rest) else rest


def statistics(text: str) -> list[float]:
    """Values of :data:`FEATURES` over a whole text, which must not be blank (see :func:`blank`)."""
    lines = [x for x in (y.strip() for y in _LINES.split(text)) if x]
    flat = text.split()
    n, n_lines, n_words = len(text), max(len(lines), 1), max(len(flat), 1)
    signs = Counter(text)
    kinds = dict.fromkeys(("letter", "mark", "digit", "blank", "plain", "other"), 0)
    for c, k in signs.items():
        kinds[_KINDS[c]] += k
    solid = max(n - kinds["blank"], 1)
    letters, marks, digits = kinds["letter"], kinds["mark"], kinds["digit"]
    separators = sum(k for c, k in signs.items() if c in _SEPARATOR_SIGNS)
    counts: dict[str, int] = {}
    sentences = 0
    for w, k in Counter(flat).items():
        b = w.strip(_WORD_EDGE)
        if b:
            b = b.lower()
            counts[b] = counts.get(b, 0) + k
            if w[-1] not in b and w.rstrip(_QUOTES)[-1] in _STOPS:
                sentences += k
    said = max(sum(counts.values()), 1)
    common = length = long_words = letter_words = verbs = stray = 0
    for w, k in counts.items():
        n_w = len(w)
        length += n_w * k
        if w in COMMON_WORDS:
            common += k
        if n_w > 24:
            long_words += k
        kind = _KINDS[w[0]]
        if kind == "letter" and not (digits and _DIGITS.search(w)):
            letter_words += k
        elif kind == "mark":
            stray += k
        if w.endswith(_VERB_ENDS):
            verbs += k
    if signs["\ufffd"]:
        stray += len(_STRAY.findall(text))
    per_line = [len(x.split()) for x in lines]
    repeated = 1 - len(set(lines)) / n_lines
    heads = [m.group().strip().strip(_WORD_EDGE).lower() for x in lines if (m := _BULLET.match(x))]
    listed = len(heads)
    common = max(common - sum(h in COMMON_WORDS for h in heads), 0)  # "a)" is no article
    verse = sum(k in (3, 4, 5) and not _DIGITS.search(x) and not _BULLET.match(x) and not _SEPARATORS.search(x[:-2]) and not _PAIR.search(x) for k, x in zip(per_line, lines))
    raw = text.encode("utf-8", "surrogatepass")
    return [
        float(said),
        length / said,
        kinds["other"] / solid,
        sum(bool(_LINE_END.search(x)) for x in lines) / n_lines,
        common / said,
        digits / solid,
        separators / n,
        (letters + marks) / solid,
        signs["\ufffd"] / solid,
        min(n_words / n_lines, 60.0),
        sum(k <= 2 for k in per_line) / n_lines,
        verse / n_lines,
        listed / n_lines,
        len(counts) / said,
        max(counts.values(), default=0) / said,
        repeated,
        long_words / said,
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
        signs[","] / said,
        (signs["<"] + signs["&"] + signs["{"]) / solid,
        stray / said,
        sentences / said,
        letter_words / said,
        sum(bool(_PAIR.search(x)) for x in lines) / n_lines,
        verbs / said,
        min(n / 100, 40.0),
    ]


def weak_label(s: list[float]) -> int | None:
    """1 for evident junk, 0 for evident prose or verse, nothing for the rest."""
    v = dict(zip(FEATURES, s))
    wordy = v["letter_ratio"] > 0.85 and v["letter_word_share"] > 0.9 and v["replacement_ratio"] == 0 and v["tag_ratio"] < 0.002
    if wordy and v["pair_line_share"] < 0.3 and v["common_word_share"] > 0.14 and v["repeated_line_share"] < 0.3 and v["list_line_share"] < 0.25 and v["top_word_share"] < 0.3 and v["unique_word_share"] > 0.3:
        return 0
    if wordy and v["verse_line_share"] > 0.85 and v["list_line_share"] < 0.1 and v["unique_word_share"] > 0.6 and v["long_word_share"] < 0.02 and v["separator_ratio"] < 0.01 and 0.12 < v["squeeze"]:
        return 0
    if v["common_word_share"] < 0.09 and (
        v["replacement_ratio"] > 0.05
        or v["symbol_ratio"] > 0.2
        or v["digit_ratio"] > 0.2
        or v["list_line_share"] > 0.6
        or v["separator_ratio"] > 0.03
        or v["tag_ratio"] > 0.02
        or v["long_word_share"] > 0.3
        or (v["short_line_share"] > 0.7 and v["words_per_line"] < 3)
        or v["comma_share"] > 0.5
        or v["pair_line_share"] > 0.5
    ):
        return 1
    if v["n_words"] > 8 and (v["top_word_share"] > 0.5 or v["repeated_line_share"] > 0.6 or v["unique_word_share"] < 0.12):
        return 1
    return None


def structural_junk(text: str, k: int) -> str:
    """By turns: one piece of a text over and over, a small table, pairs, a column, a row or a list of its words; half of the last ones behind an opening sentence."""
    w = [x for x in (y.strip(_WORD_EDGE) for y in text.split()) if x][:60] or ["x"]
    many = 8 + 7 * (k % 9)
    word = lambda i: w[(i * 7 + k) % len(w)]
    kind = k % 8
    if kind == 0:
        return " ".join([w[0]] * many)
    if kind == 1:
        return "\n".join([" ".join([word(0)] * 12)] * (1 + many // 12))
    if kind in (2, 3):
        gap = "\t|,;"[(k // 8) % 4] if k % 3 else "   "
        rows = [gap.join(word(r * 5 + c) if (r + c + k) % 3 == 0 else f"{(r * 37 + c * 11 + k) % 997}{'.5' * (c % 2)}" for c in range(3 + k % 4)) for r in range(4 + k % 12)]
    elif kind == 4:
        sign = ":=-"[(k // 8) % 3]
        rows = [f"{word(3 * r)} {sign} {word(3 * r + 1)}{' ' + word(3 * r + 2) if r % 2 else ''}" for r in range(4 + k % 9)]
    elif kind == 5:
        rows = [word(r) for r in range(6 + k % 15)]
    elif kind == 6:
        rows = [", ".join(word(r) for r in range(8 + k % 20))]
    else:
        rows = [f"{('-', '•', f'{r + 1}.')[(k // 8) % 3]} {word(2 * r)}{' ' + word(2 * r + 1) if r % 2 else ''}" for r in range(4 + k % 12)]
    return "\n".join([" ".join(w[:9]) + "."] * ((k // 8) % 2) + rows)


def fit(texts: list[str], holdout: tuple[tuple[str, int], ...] = HOLDOUT) -> BoostedTrees:
    """Trees from the weakly labelled ones of the texts, calibrated on the hand-checked holdout."""
    held = [(statistics(body(t)), y) for t, y in holdout]
    rows = [(s, y) for s in map(statistics, map(body, texts)) if (y := weak_label(s)) is not None]
    rows += [(statistics(structural_junk(t, k)), 1) for k, t in enumerate(texts[::8])]
    if len({y for _, y in rows}) < 2:
        rows += held  # a sample of one kind only
    x, y = np.array([s for s, _ in rows]), np.array([k for _, k in rows], dtype=float)
    model = BoostedTrees().fit(x, y)
    return model.calibrate(np.array([s for s, _ in held]), np.array([k for _, k in held], dtype=float))


def text_quality(df: DataFrame, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id``, the statistics, ``junk_probability`` and ``connected`` of every document.

    Null and blank texts, and those of invisible characters only, have zero statistics and null for the last two. The sample for the fit is
    chosen by hash of the identifier, ``fit_rows`` rows at most; nothing else depends on it.
    """
    spark = df.sparkSession
    present = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null and t <> ''")
    ids = [r.i for r in present.select("i").orderBy(F.xxhash64("i"), "i").limit(fit_rows).collect()]
    cut = max((i for i in ids), default=None)
    texts: list[str] = []
    if cut is not None:
        wanted = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("i", df.schema[id_col].dataType)]))
        texts = [r.t for r in present.join(F.broadcast(wanted), "i", "left_semi").select("t").toLocalIterator() if not blank(r.t)]
    model = spark.sparkContext.broadcast(fit(texts))
    kind = df.schema[id_col].dataType
    fields = [T.StructField("id", kind)] + [T.StructField(n, T.DoubleType()) for n in STATISTICS] + [T.StructField("junk_probability", T.DoubleType()), T.StructField("connected", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.column(1).to_pylist()
            none = np.array([blank(t) for t in given])
            main = ["" if b else body(t) for t, b in zip(given, none)]
            x = np.array([[0.0] * len(FEATURES) if b else statistics(t) for t, b in zip(main, none)])
            p = m.probability(x)
            for k in np.flatnonzero([not b and len(a) < len(t) for a, t, b in zip(main, given, none)]):
                x[k] = statistics(given[k])  # the published ones are over the whole text
            cols = [batch.column(0)] + [pa.array(x[:, k]) for k in range(len(STATISTICS))]
            cols += [pa.array(p, mask=none), pa.array(p < 0.5, mask=none)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType(fields))
