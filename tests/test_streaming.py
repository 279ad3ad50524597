"""The verse reader: the same at every split point, equal to the column expressions, and as a stream."""


from pyspark.sql import functions as F

from tests.test_metre import COUPLETS
from vrittam.functions import prosody as P
from vrittam.operators import metre
from vrittam.streaming.reader import VerseState
from vrittam.streaming.streams import read_lines, read_stream, script_tokens, token_mask

TEXT = "సత్యధర్మము చేయుము\nపాల్ ద్రావి దుఃఖం"


def test_split_points():
    whole = VerseState().feed(TEXT)
    for k in range(len(TEXT) + 1):
        first = VerseState().feed(TEXT[:k])
        assert VerseState.from_row(first.to_row()).feed(TEXT[k:]) == whole


def test_reader_equals_expressions(spark):
    rows = [(i, t) for i, t in enumerate([*COUPLETS, *COUPLETS, TEXT])]
    df = spark.createDataFrame(rows, "id int, poem string")
    two = metre.with_lines(df, "poem").select("id", *[P.weights(P.syllables(F.col(f"line{k}"))).alias(f"g{k}") for k in "12"])
    want = {r.id: f"{r.g1}|{r.g2}" for r in two.collect()}
    got = {r.id: r for r in read_lines(df, "id", "poem").collect()}
    assert {i: r.weights for i, r in got.items()} == want
    assert all(got[i].all_valid for i in range(len(rows) - 1))


def test_alive_never_drops_a_valid_line():
    for couplet in COUPLETS:
        s = VerseState()
        for c in couplet:
            s = s.feed(c)
            assert s.alive(), (couplet, s)
        assert s.accepts()
    assert not VerseState().feed("కూకూకూకూ ").alive()


def test_rhyme_is_watched():
    s = VerseState().feed("సౌధాగ్రముల యందు సదనంబు లందు\nవీమల యందు")
    assert not s.alive() and s.rhymes == ("ధ",)


def test_mask(spark):
    tokens = spark.createDataFrame([(1, "ంద"), (2, "క"), (3, "మామామా "), (4, "abc"), (5, "")], "token_id int, token_text string")
    assert {r.token_id for r in script_tokens(tokens).collect()} == {1, 2, 3}
    pre = spark.createDataFrame([("కూ",), ("",)], "prefix string")
    got = {(r.prefix, r.token_id) for r in token_mask(pre, tokens).collect()}
    want = {(p, i) for p in ("కూ", "") for i, t in [(1, "ంద"), (2, "క"), (3, "మామామా "), (4, "abc"), (5, "")] if VerseState().feed(p + t).alive()}
    assert got == want and ("కూ", 3) not in got


def test_stream(spark, tmp_path):
    src, k = tmp_path / "in", 5
    rows = [(str(i), j, t[j * k : (j + 1) * k]) for i, t in enumerate(COUPLETS) for j in range(len(t) // k + 1)]
    half = len(rows) // 2
    schema = "stream_id string, seq bigint, chunk string"
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = read_stream(stream).writeStream.format("memory").queryName("verse").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.stream_id, r.seq): r for r in spark.sql("select * from verse").collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(COUPLETS):
        last = got[str(i), len(t) // k]
        assert last.accepts and last.line_no == 2 and last.weights == VerseState().feed(t).line()


def test_alive_counts(spark):
    """Counts by shared states equal the mask pair by pair; whole first words and whole glossed words in the query."""
    from vrittam.streaming.streams import alive_counts

    words = sorted({w for c in COUPLETS for w in c.split()})[:25] + ["", "ab", "మా\nమా", "క్", "ఁక", "1x"]
    starts = sorted({w for c in COUPLETS for w in c.split()})[::2] + ["కూ", "x", "క్"]
    tokens = spark.createDataFrame(list(enumerate(words)), "token_id int, token_text string")
    got = {r.prefix: r.n_alive for r in alive_counts(spark.createDataFrame([(p,) for p in starts], "prefix string"), tokens).collect()}
    want = {p: sum(VerseState().feed(p + t).alive() for t in words) for p in starts}
    assert got == {p: n for p, n in want.items() if n}


def test_token_candidates_take_whole_words(spark, tmp_path):
    from vrittam.plans.verse import token_candidates

    rows = [(1, "సత్యధర్మము చేయుము\nపాల్ ద్రావి", {"సత్యము": "truth", "పాలు": "milk"}), (2, " మా x", {"సత్యము": "truth"}), (3, None, None)]
    spark.createDataFrame(rows, "rec_id int, poem string, word_to_word_meaning map<string,string>").write.parquet(str(tmp_path / "dwipada_augmented_dataset.parquet"))
    got = {r.prefix: r.n_alive for r in token_candidates(spark, str(tmp_path)).collect()}
    want = {p: sum(VerseState().feed(p + t).alive() for t in ("సత్యము", "పాలు")) for p in ("సత్యధర్మము", "మా")}
    assert got == {p: n for p, n in want.items() if n} and "సత్యధర్మము" in got


def test_alliteration_while_reading(spark):
    """A line whose third foot begins like the first stays alive at every letter; one that cannot any more does not come back."""
    from vrittam.streaming.reader import VerseState
    from vrittam.streaming.streams import masked_scores, prefix_states

    for couplet in COUPLETS:
        line = couplet.split("\n")[0]
        assert all(VerseState().feed(line[:k]).yati_alive() for k in range(len(line) + 1))
        first = line[0]
        other = next(c for c in "కచటతపమ" if c != first and not any(c in g and first in g for g in ("కఖగఘ", "చఛజఝశషస", "టఠడఢ", "తథదధ", "పఫబభవ")))
        words = line.split(" ")
        bad = " ".join([words[0], words[1], other + words[2][1:], words[3]]) + " కకక"
        seen = [VerseState().feed(bad[:k]).yati_alive() for k in range(len(bad) + 1)]
        assert seen == sorted(seen, reverse=True)
    df = spark.createDataFrame([(1, COUPLETS[0]), (2, None), (3, "".join(chr(ord(c) + 0x80) if "\u0c00" <= c <= "\u0c7f" else c for c in COUPLETS[0]))], "id int, text string")
    got = {r.id: r for r in prefix_states(df, "id", "text", kannada=True).collect()}
    assert got[1].line_no == 2 and got[1].accepts and got[2].weights == "" and got[2].alive and got[3].weights == got[1].weights
    scores = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("a", 9, 0.1), ("b", 1, 0.75)], "prefix string, token_id int, score double")
    mask = spark.createDataFrame([("a", 2, True)], "prefix string, token_id int, accepts boolean")
    assert {(r.prefix, r.token_id): r.score for r in masked_scores(scores, mask, end_token=9).collect()} == {("a", 1): float("-inf"), ("a", 2): 0.25, ("a", 9): 0.1, ("b", 1): 0.75}
