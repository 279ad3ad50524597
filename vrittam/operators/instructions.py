"""Instruction records from couplet records: templates by profile, corrupted verse with its correction, analysis texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import foot_name_list, foot_pattern_list, gloss_lines, quoted_letter, replace_nth_letter
from ..functions.prosody import lines, strip
from .profiles import uniform

# The wording of the instructions.
ASK_TELUGU = "క్రింది తెలుగు భావానికి అనుగుణంగా ఒక ద్విపద పద్యం రచించండి. ప్రతి పాదంలో 3 ఇంద్ర గణాలు + 1 సూర్య గణం ఉండాలి.\n\nతెలుగు భావం: "
ASK_ENGLISH = "క్రింది ఆంగ్ల భావానికి అనుగుణంగా ఒక ద్విపద పద్యం రచించండి. ప్రతి పాదంలో 3 ఇంద్ర గణాలు + 1 సూర్య గణం ఉండాలి.\n\nEnglish meaning: "
ASK_BY_RULES = "\nపై నియమాలను పాటిస్తూ క్రింది భావానికి ద్విపద రచించండి.\n\nభావం: "
RULES = (
    "ద్విపద నియమాలు:\n"
    "- సూర్య గణాలు: న (III), హ/గల (UI)\n"
    "- ప్రాస: రెండు పాదాల 2వ అక్షరం హల్లు సమానంగా ఉండాలి\n"
    "- యతి: ప్రతి పాదంలో 1వ గణం మొదటి అక్షరం = 3వ గణం మొదటి అక్షరం\n"
)
NO_GLOSS, NO_ANALYSIS, NO_PATTERN, NO_NAMES = "Word breakdown not available.", "Analysis not available.", "Syllable pattern not available.", "Gana names not available."
#: Letters put in the place of a right one: the first, or the second where the right one is the first.
WRONG_RHYME, WRONG_ALLITERATION = ("క", "మ"), ("జ", "క")


def templates() -> dict[str, tuple[Column, str]]:
    """Instruction of each of the four generation profiles, null where the record lacks its meaning, and its style tag."""
    telugu, english = (F.nullif(F.col(c), F.lit("")) for c in ("telugu_meaning", "english_meaning"))
    return {
        "GN1": (F.concat(F.lit(ASK_TELUGU), telugu), "[Telugu_Bhavam]"),
        "GN2": (F.concat(F.lit(ASK_ENGLISH), english), "[English_Meaning]"),
        "GN3": (F.concat(F.lit(ASK_TELUGU), telugu), "[Human_Style]"),
        "GN4": (F.concat(F.lit(RULES + ASK_BY_RULES), telugu), "[Scholarly]"),
    }


def chat_records(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``id``, ``profile_id``, ``source_tag``, ``instruction``, ``output``: one of the four profiles by equal chance.

    Where the record cannot serve the one drawn, the first that it can serve, in their order; a
    record that can serve none, or without a poem, has no row.
    """
    made = templates()
    parts = [F.when(text.isNotNull(), F.struct(F.lit(p).alias("profile_id"), F.lit(tag).alias("source_tag"), text.alias("instruction"))) for p, (text, tag) in made.items()]
    drawn = F.element_at(F.array(*parts), (F.floor(uniform(seed, F.col(id_col)) * len(parts)) + 1).cast("int"))
    poem = strip(F.col("poem"))
    out = df.filter(poem != "").select(F.col(id_col).alias("id"), F.coalesce(drawn, *parts).alias("r"), poem.alias("output"))
    return out.filter("r is not null").select("id", "r.*", "output").select("id", "profile_id", "source_tag", "instruction", "output")


def analysis_texts(df: DataFrame, id_col: str) -> DataFrame:
    """``id`` and the texts instructions quote: ``gloss``, ``analysis``, ``pattern``, ``names``; a fixed text where a field is missing."""
    ca = "chandassu_analysis"
    said = lambda k, f: F.coalesce(F.col(f"{ca}.{k}.{f}"), F.lit(""))
    line = lambda k: F.when(F.col(f"{ca}.{k}").isNotNull(), F.concat(F.lit(f"{k}: "), said(k, "breakdown"), F.lit(" | Yati: "), said(k, "yati_check"), F.lit(" | Prasa: "), said(k, "prasa_check")))
    breakdown = said("line_1", "breakdown")
    patterns, names = foot_pattern_list(breakdown), foot_name_list(breakdown)
    return df.select(
        F.col(id_col).alias("id"),
        F.when(F.size(F.map_keys("word_to_word_meaning")) > 0, gloss_lines(F.col("word_to_word_meaning"))).otherwise(NO_GLOSS).alias("gloss"),
        F.coalesce(F.nullif(F.concat_ws("\n", line("line_1"), line("line_2")), F.lit("")), F.lit(NO_ANALYSIS)).alias("analysis"),
        F.when(breakdown == "", NO_PATTERN).when(F.size(patterns) > 0, F.array_join(patterns, " | ")).otherwise(breakdown).alias("pattern"),
        F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(NO_NAMES).alias("names"),
    )


def corrupted(df: DataFrame, id_col: str) -> DataFrame:
    """``id``, ``kind`` (rhyme, alliteration), ``letter`` (the right one, or both joined), ``wrong``, ``right``: couplets with one wrong letter.

    Rhyme: the second letter of the second line is another one; only records whose analysis names the
    rhyme letter. Alliteration: the first letter of the first line. Lines without so many letters stay as
    they are; poems of fewer than two lines give no row.
    """
    two = df.withColumn("_l", lines(F.col("poem"))).filter(F.size("_l") >= 2)
    l1, l2 = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    right = F.concat_ws("\n", l1, l2)
    rhyme = quoted_letter(F.col("chandassu_analysis.line_1.prasa_check"))
    yati = F.col("chandassu_analysis.line_1.yati_check")
    both = F.concat_ws(" మరియు ", quoted_letter(yati), quoted_letter(yati, 2))
    other = lambda c, pair: F.when(c == pair[0], pair[1]).otherwise(pair[0])
    first = F.regexp_extract(l1, r"[\x{0C00}-\x{0C7F}]", 0)
    a = two.filter(rhyme.isNotNull()).select(F.col(id_col).alias("id"), F.lit("rhyme").alias("kind"), rhyme.alias("letter"), F.concat_ws("\n", l1, replace_nth_letter(l2, 2, other(rhyme, WRONG_RHYME))).alias("wrong"), right.alias("right"))
    b = two.select(F.col(id_col).alias("id"), F.lit("alliteration").alias("kind"), F.nullif(both, F.lit("")).alias("letter"), F.concat_ws("\n", replace_nth_letter(l1, 1, other(first, WRONG_ALLITERATION)), l2).alias("wrong"), right.alias("right"))
    return a.unionByName(b)


def prompt_text(kind: str, poem: Column, **parts: Column) -> Column:
    """A request to a judge or translator: the rubric or the rules, the metadata given as ``parts`` (null ones left out), the poem."""
    # The heads of the requests.
    heads = {"rubric": "Judge the couplet below from 1 to 5 for each of: metre, rhyme, alliteration, meaning, language.", "rules": RULES, "metadata": "Explain the couplet below."}
    lines_ = [F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()]
    return F.concat_ws("\n\n", F.lit(heads[kind]), *[F.nullif(F.concat_ws("\n", *lines_), F.lit(""))] * bool(lines_), F.concat(F.lit("Poem:\n"), poem))


def chat_turns(template: str, user: Column, answer: Column) -> Column:
    """A user and an assistant turn as one string in the turn marks of ``gemma``, ``chatml`` or ``llama``; without the answer if it is null."""
    # The turn marks.
    marks = {
        "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n", "<end_of_turn>"),
        "chatml": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
        "llama": ("[INST] ", " [/INST] ", "</s>"),
    }
    begin, middle, end = marks[template]
    return F.concat(F.lit(begin), user, F.lit(middle), F.coalesce(F.concat(answer, F.lit(end)), F.lit("")))
