"""Parts of model answers and of analysis texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prosody import strip

TELUGU = r"\x{0C00}-\x{0C7F}"


def section(text: Column, *titles: str) -> Column:
    """Body of the first Markdown section whose heading or bold label holds one of the titles; null if there is none."""
    names = "|".join(titles)
    pattern = rf"(?si)(?:^|\n)\s*(?:#+|\*\*)[^\n]*?(?:{names})[^\n:*]*[:*]*[ \n]+(.*?)(?=\n\s*(?:#+|\*\*)|\z)"
    body = strip(F.regexp_extract(text, pattern, 1))
    return F.when(body != "", body)


def plain_field(text: Column) -> Column:
    """Text without bullets and bold marks."""
    t = F.regexp_replace(text, r"\*\*|__", "")
    return strip(F.regexp_replace(t, r"(?m)^\s*[*•-]\s+", ""))


def gloss(text: Column) -> Column:
    """Word-by-word meanings as a map: one pair per line or between semicolons, ``word = meaning`` or ``word: meaning``; the last of equal words wins."""
    pieces = F.filter(F.transform(F.split(plain_field(text), r"[\n;]+"), strip), lambda x: x.rlike(r"^[^=:]+[=:]"))
    pairs = F.transform(pieces, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^=:]+)[=:]", 1)).alias("k"), strip(F.regexp_replace(x, r"^[^=:]+[=:]", "")).alias("v")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda z: z["k"] == e["k"]))
    return F.map_from_entries(last)


def gloss_lines(m: Column) -> Column:
    """Map of meanings as ``word: meaning`` lines."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def two_languages(block: Column) -> Column:
    """``telugu`` and ``english`` of a meaning that holds both, line by line by script."""
    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
    latin = lambda x: x.rlike(r"^\(?[A-Za-z]")
    return F.struct(F.array_join(F.filter(lines, lambda x: ~latin(x)), " ").alias("telugu"), F.array_join(F.filter(lines, latin), " ").alias("english"))


def quoted_letter(text: Column, nth: int = 1) -> Column:
    """The ``nth`` quoted single Telugu character of an analysis text; null without it."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"'([{TELUGU}])'"), F.lit(1)), F.lit(nth - 1))


def foot_name_list(breakdown: Column) -> Column:
    """Names of the feet in a written analysis."""
    return F.regexp_extract_all(breakdown, F.lit(r"\(([A-Za-z/]+)\s*[-–]"), F.lit(1))


def foot_pattern_list(breakdown: Column) -> Column:
    """Weights of the feet in a written analysis."""
    return F.regexp_extract_all(breakdown, F.lit(r"\b([IU]{2,})\b"), F.lit(1))


def replace_nth_letter(line: Column, n: int, by: Column) -> Column:
    """Line whose ``n``-th Telugu character is another one; unchanged if it has fewer."""
    before = rf"^((?:[^{TELUGU}]*[{TELUGU}]){{{n - 1}}}[^{TELUGU}]*)[{TELUGU}]"
    return F.when(line.rlike(before), F.concat(F.regexp_extract(line, before, 1), by, F.regexp_replace(line, before, ""))).otherwise(line)


def rolling_hash(text: Column) -> Column:
    """32-bit rolling hash (31 h + code) of a text as ``id-`` and hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295).cast("bigint")))
    return F.concat(F.lit("id-"), F.lower(F.hex(h)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigrams(weights: Column) -> Column:
    """Neighbouring weights of a weight string."""
    n = F.length(weights)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(weights, i, F.lit(2))))


def longest_run(a: Column, b: Column) -> Column:
    """Length of the longest common run of two weight strings."""
    n = F.length(a)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    best = F.transform(starts, lambda i: F.array_max(F.transform(F.sequence(F.lit(0), n - i + 1), lambda k: F.when(F.instr(b, F.substring(a, i, k)) > 0, k).otherwise(0))))
    return F.when((n == 0) | (F.length(b) == 0), 0).otherwise(F.array_max(best))


def alliteration_text(first: Column, third: Column, matches: Column) -> Column:
    """Written result of the alliteration of a line; null without both letters."""
    return F.concat(F.when(matches, "Matches: '").otherwise("No match: '"), first, F.lit("' and '"), third, F.lit("'."))


def rhyme_text(own: Column, other: Column, matches: Column) -> Column:
    """Written result of the rhyme for one line; null without both syllables."""
    return F.when(matches, F.concat(F.lit("2nd Letter '"), own, F.lit("' matches '"), other, F.lit("'."))).otherwise(F.concat(F.lit("No match: '"), own, F.lit("' and '"), other, F.lit("'.")))


def alliteration_read(text: Column) -> Column:
    """``first``, ``third``, ``matches`` read back from a written result; null where it names fewer than two letters."""
    letters = F.regexp_extract_all(text, F.lit(r"'([^']+)'"), F.lit(1))
    low = F.lower(text)
    matches = F.contains(low, F.lit("match")) & ~F.contains(low, F.lit("no match"))
    return F.when(F.size(letters) >= 2, F.struct(F.get(letters, F.lit(0)).alias("first"), F.get(letters, F.lit(1)).alias("third"), matches.alias("matches")))


def verse_of_prompt(prompt: Column) -> Column:
    """The couplet a prompt quotes: two neighbouring lines of Telugu behind a line that ends in a colon; null without them."""
    got = F.regexp_extract(prompt, rf"(?s):\s*\n([{TELUGU} ]+\n[{TELUGU} ]+)", 1)
    return F.when(got != "", got)
