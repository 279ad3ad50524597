"""Classes of letters, comparison of words, shapes of lines, verdicts of the automata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A
from . import prosody as P


def articulation(consonant: Column) -> Column:
    """Place of articulation of a consonant; null for anything else."""
    out = None
    for name, members in A.ARTICULATION.items():
        cond = consonant.isin(*members)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def tags(syllable: Column) -> Column:
    """Properties of a syllable as a sorted array: vowel, consonant, long, diphthong, nasal, breath, cluster, double, final."""
    c = P._C
    double = F.regexp_extract(syllable, f"([{c}]){A.VIRAMA}\\1", 0) != ""
    first = F.substring(syllable, 1, 1)
    found = [
        F.when(double, "double"),
        F.when(first.isin(*A.CONSONANTS), "consonant"),
        F.when(syllable.rlike(P.CLUSTER) & ~double, "cluster"),
        F.when(syllable.rlike(f"[{A.DIPHTHONGS}]"), "diphthong"),
        F.when(syllable.rlike(f"{A.VIRAMA}$"), "final"),
        F.when(syllable.rlike(f"[{A.LONG_SIGNS}]|^[{A.LONG_VOWELS}]$"), "long"),
        F.when(F.contains(syllable, F.lit("ం")), "nasal"),
        F.when(F.contains(syllable, F.lit("ః")), "breath"),
        F.when(first.isin(*A.VOWELS), "vowel"),
    ]
    return F.array_sort(F.array_compact(F.array(*found)))


def rhyme_verdict(a: Column, b: Column) -> Column:
    """How two second syllables rhyme: exact, equivalent, mismatch or no_consonant."""
    x, y = P.base_consonant(a), P.base_consonant(b)
    return F.when(x.isNull() | y.isNull(), "no_consonant").when(x == y, "exact").when(P.rhyme_letter(x) == P.rhyme_letter(y), "equivalent").otherwise("mismatch")


def ragale_valid(weights: Column) -> Column:
    """Automaton verdict of a ragale line: three feet III or IIU and a last IIU."""
    return weights.rlike("^(II[IU]){3}IIU$")


def two_first_feet(weights: Column) -> Column:
    """The weights are exactly two feet of the first kind."""
    feet = "|".join(A.INDRA)
    return weights.rlike(f"^({feet})({feet})$")


def ends_light(line: Column) -> Column:
    """The last syllable of a line is light by itself."""
    last = F.element_at(P.pure(P.syllables(line)), -1)
    return ~last.rlike(P.HEAVY)


def begins_with_cluster(line: Column) -> Column:
    return line.rlike(f"^{P.CLUSTER}")


def text_counts(text: Column) -> Column:
    """Characters, Telugu characters, words, sentences, paragraphs, and the characters outside the Telugu block as a sorted string."""
    te = F.regexp_replace(text, r"[^\x{0C00}-\x{0C7F}]", "")
    other = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"[\x{0C00}-\x{0C7F}\s]", ""), ""), lambda c: c != ""))), "")
    words = F.size(F.filter(F.split(text, f"[{A.BLANKS}]+"), lambda x: x != ""))
    sentences = F.size(F.filter(F.split(text, r"[.!?।॥]+"), lambda x: F.regexp_replace(x, f"[{A.BLANKS}]", "") != ""))
    paragraphs = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, f"[{A.BLANKS}]", "") != ""))
    return F.struct(F.length(text).alias("characters"), F.length(te).alias("telugu"), words.alias("words"), sentences.alias("sentences"), paragraphs.alias("paragraphs"), other.alias("others"))


def body_line(line: Column) -> Column:
    """Line of a poem: a line of three or more dots stays, source notes in brackets and punctuation go, a dotted beginning stays."""
    dots = line.rlike(r"^\s*\.{3,}\s*$")
    head = F.regexp_extract(line, r"^\s*(\.{3,})", 1)
    rest = F.regexp_replace(F.regexp_replace(line, r"^\s*\.{3,}", ""), r"\[[^\]]*\]", "")
    from .cleaning import clean_line

    return F.when(dots, P.strip(line)).otherwise(F.concat(head, clean_line(rest)))


def verse_line(line: Column) -> Column:
    """Verse line of a crawled page without note numbers, brackets, quotes and page numbers; null if nothing is left but dots."""
    t = F.regexp_replace(line, r"\[[0-9]+\]|[()\"'“”‘’]|[0-9]+\s*$", "")
    t = P.strip(F.regexp_replace(t, r"\s+", " "))
    return F.when(~t.rlike(r"^[.…\s]*$"), t)


def pairs(lines: Column) -> Column:
    """Lines as couplets that do not overlap; an odd last line stands alone."""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i % 2 == 1) & (i <= n))
    return F.transform(starts, lambda i: F.array_join(F.slice(lines, i, 2), "\n"))


def salvaged_objects(text: Column) -> Column:
    """JSON objects written somewhere in free text, as strings, with up to two levels of objects inside; braces in strings of theirs do not count.

    An object that is not closed is left out, the objects inside it are found.
    """
    string = r'"(?:[^"\\]|\\.)*+"'
    inner = rf'(?:[^{{}}"]|{string})*+'
    one = rf"\{{{inner}\}}"
    two = rf'\{{(?:[^{{}}"]|{string}|{one})*+\}}'
    three = rf'\{{(?:[^{{}}"]|{string}|{two})*+\}}'
    return F.regexp_extract_all(text, F.lit(three), F.lit(0))


def prompt_and_poem(text: Column) -> Column:
    """``prompt`` and ``poem`` parted at the marker line; line ends of the poem get a blank before them."""
    at = F.instr(text, "Poem:\n")
    poem = F.regexp_replace(F.substring(text, at + 6, F.length(text)), "\n", " \n")
    return F.struct(F.when(at > 0, P.strip(F.substring(text, F.lit(1), at - 1))).otherwise(text).alias("prompt"), F.when(at > 0, poem).alias("poem"))


# The classes of a code point, tested in this order, and the classes of letters a syllable is tagged with.
CODE_POINTS = {
    "CONSONANT": "కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరలవశషసహళఱ",
    "INDEPENDENT_VOWEL": "అఆఇఈఉఊఋౠఎఏఐఒఓఔ",
    "MATRA": "ాిీుూృెేైొోౌౖ",
    "VIRAMA": "్",
    "DIACRITIC": "ంః",
    "SPACE": " ",
    "NEWLINE": "\n",
    "SKIP": "\u200c\u200bఁ",
}
LETTER_CLASSES = {
    "pluta": "ఐఔ",
    "sarala": "గజడదబ",
    "parusha": "కచటతప",
    "sthira": "ఖఘఙఛఝఞఠఢణథధనఫభమయరఱలళవశషసహ",
    "ka_varga": "కఖగఘఙ",
    "cha_varga": "చౘఛజౙఝఞ",
    "ta_varga": "టఠడఢణ",
    "tha_varga": "తథదధన",
    "pa_varga": "పఫబభమ",
    "sparsha": "కఖగఘఙచౘఛజౙఝఞటఠడఢణతథదధనపఫబభమ",
    "ushma": "శసషహ",
    "antastha": "యరఱలళవ",
    "kanthya": "అఆకఖగఘఙహ",
    "talavya": "ఇఈచఛజఝయశ",
    "murdhanya": "ఋౠటఠడఢణషఱర",
    "dantya": "ఌౡతథదధౘౙలస",
    "oshthya": "ఉఊపఫబభమ",
    "anunasika": "ఙఞణనమ",
    "kanthatalavya": "ఎఏఐ",
    "kanthoshthya": "ఒఓఔ",
    "dantoshthya": "వ",
}


def code_point_class(char: Column) -> Column:
    """Class of one character; ``OTHER`` for one of none."""
    out = None
    for name, members in CODE_POINTS.items():
        cond = char.isin(*members)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("OTHER")


def only_script(text: Column, first: str = r"\x{0C00}", last: str = r"\x{0C7F}") -> Column:
    """A text, or token, of letters of one block, blanks, line ends and colons only; false for an empty one."""
    return text.rlike(f"^[{first}-{last} \\n:]+$")


def syllable_classes(syllable: Column) -> Column:
    """All properties of a syllable as a sorted array: kinds (``vowel``, ``consonant``, ``long``, ``short``, ...) and classes of its letters.

    A vowel sign counts as its vowel besides; a consonant without a sign has the inherent one.
    """
    cons, marks = f"[{A.CONSONANTS}]", f"[{A.SIGNS}]"
    first = F.substring(syllable, 1, 1)
    vowel = first.isin(*A.VOWELS) | syllable.isin(*A.DIACRITICS)
    has_cons = syllable.rlike(cons)
    long = syllable.rlike(f"[{A.LONG_SIGNS}]") | syllable.isin(*A.LONG_VOWELS)
    breath, nasal = F.contains(syllable, F.lit("ః")), F.contains(syllable, F.lit("ం"))
    double = syllable.rlike(f"({cons}){A.VIRAMA}\\1")
    # overlapping pairs: a cluster of different consonants stands somewhere
    other = syllable.rlike(f"({cons}){A.VIRAMA}(?!\\1){cons}")
    signs = F.translate(F.array_join(F.regexp_extract_all(syllable, F.lit(marks), F.lit(0)), ""), A.SIGNS, A.SIGN_VOWELS)
    inherent = F.when(has_cons & ~syllable.rlike(marks) & ~F.endswith(syllable, F.lit(A.VIRAMA)), "అ").otherwise("")
    all_letters = F.concat(syllable, signs, inherent)
    found = [
        F.when(vowel, "vowel"),
        F.when(has_cons, "consonant"),
        F.when(long, "long"),
        F.when(breath, "breath"),
        F.when(nasal, "nasal"),
        F.when(other, "cluster"),
        F.when(double, "double"),
        F.when((has_cons | vowel) & ~long & ~nasal & ~breath, "short"),
        *[F.when(all_letters.rlike(f"[{members}]"), name) for name, members in LETTER_CLASSES.items()],
    ]
    return F.array_sort(F.array_compact(F.array(*found)))


def positions(syllables: Column) -> Column:
    """Map from each different syllable to its places, from 0."""
    return F.map_from_arrays(
        F.array_distinct(syllables),
        F.transform(F.array_distinct(syllables), lambda s: F.filter(F.transform(syllables, lambda x, i: F.when(x == s, i)), lambda i: i.isNotNull())),
    )


def text_profile(text: Column) -> Column:
    """Counts, shares and most frequent classes of one text: the whole description as one struct.

    Characters that are no Telugu letters, blanks or line ends are taken out first. Percentages are
    null for a text without syllables.
    """
    kept = F.regexp_replace(text, r"[^\x{0C00}-\x{0C7F}\s\x{200B}]+", "")
    syl = P.pure(P.syllables(kept))
    weights = P.weights(P.syllables(kept))
    heavy = F.length(F.translate(weights, "I", ""))
    n = F.size(syl)
    parts = lambda x, sep: F.size(F.filter(F.split(x, sep), lambda y: F.regexp_replace(y, f"[{A.BLANKS}]", "") != "")).cast("bigint")
    return F.struct(
        F.length(kept).cast("bigint").alias("characters"),
        parts(kept, f"[{A.BLANKS}]+").alias("words"),
        parts(kept, r"[।॥.?!]").alias("sentences"),
        parts(kept, "\n").alias("paragraphs"),
        n.cast("bigint").alias("syllables"),
        F.size(F.array_distinct(syl)).cast("bigint").alias("different"),
        F.size(F.filter(syl, lambda x: x.rlike(P.CLUSTER))).cast("bigint").alias("clusters"),
        heavy.cast("bigint").alias("heavy"),
        F.round(F.when(n > 0, heavy * 100.0 / n), 2).alias("heavy_pct"),
    )
