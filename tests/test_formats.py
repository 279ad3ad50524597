"""Sources, pages, extraction, cleaning and scripts."""

import json

from pyspark.sql import functions as F

from vrittam.functions import cleaning, extract, letters, scripts
from vrittam.functions.names import clean_source
from vrittam.operators import curate, lines
from vrittam.sources import formats, pages


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_json_both_ways(spark, tmp_path):
    rows = [{"poem_kannada": "a", "theme": "b"}, {"poem_kannada": "c", "theme": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for f in ("a.json", "b.jsonl"):
        assert [r.poem_kannada for r in formats.read_json(spark, str(tmp_path / f), formats.RAGALE).collect()] == ["a", "c"]


def test_texts_tokens_and_splits(spark, tmp_path):
    (tmp_path / "data/work_a/x").mkdir(parents=True)
    (tmp_path / "data/work_a/x/01.txt").write_text("# k: v\n\nఅ\nఆ\n")
    got = formats.read_texts(spark, str(tmp_path / "data")).collect()
    assert [(r.path, r.work) for r in got] == [("work_a/x/01.txt", "work_a")]
    (tmp_path / "t.tsv").write_text('token_id\ttoken_text\n5\t"అ\n7\tఆ\n')
    assert [(r.token_id, r.token_text) for r in formats.read_tokens(spark, str(tmp_path / "t.tsv")).collect()] == [(5, '"అ'), (7, "ఆ")]
    formats.write_splits(spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).filter("split = 'train'").first().x == "a"


def test_requests_and_responses(spark):
    df = spark.createDataFrame([("w", 3, "ask")], "work string, n int, p string")
    req = formats.requests(df, F.lit("k"), F.col("p"), F.struct(F.lit("f").alias("source_file"), F.col("work"), F.col("n").alias("couplet_number")))
    flat = formats.without_roles(req).first()
    assert flat.key == "w__3" and flat.request.contents[0].parts[0].text == "ask"
    raw = [{"key": "a", "response": {"candidates": [{"content": {"parts": [{"text": "t"}]}}]}}, {"key": "b", "response": {"candidates": []}}, {"key": "c"}]
    got = spark.read.schema(formats.RESPONSE).json(spark.sparkContext.parallelize(map(json.dumps, raw)))
    assert {r.key: (r.text, r.reason) for r in formats.responses(got).collect()} == {"a": ("t", None), "b": (None, "no candidates"), "c": (None, "no response")}


PAGE = """<html><title>T</title><div class="mw-parser-output"><h2>One<span class="mw-editsection">[x]</span></h2><p>intro</p>
<div class="poem"><p>అ ఆ<br/>ఇ ఈ<sup class="reference">[1]</sup></p></div><h2>Two</h2><p>text &amp; more<span class="pagenum">12</span></p></div></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    got = [(r.id, r.title, r.no, r.heading, r.text) for r in pages.sections(df, "page_id", "html").orderBy("no").collect()]
    assert got == [(1, "T", 1, "One", "అ ఆ\nఇ ఈ"), (1, "T", 2, "Two", "text & more")]
    assert pages.parse_page(None) == ("", []) and pages.parse_notes("") == []
    chain = '<title>T</title><div>menu</div><div class="a mw-parser-output">{}</div><p>after</p>'
    assert pages.parse_page(chain.format("<h2>Contents</h2><h3>One</h3><p>x</p><h3>Two</h3><div class='poem'>a<br>b</div>")) == ("T", [("One", "x"), ("Two", "a\nb")])
    centred = '<div class="tiInherit" style="text-align: center"><p>{}</p></div>'
    assert pages.parse_page(chain.format(centred.format("Work") + centred.format("Part") + "<p>x</p>"), names=("Work",))[1] == [("", "Work"), ("Part", "x")]
    assert pages.parse_page(chain.format("<p><b>Bold</b></p><p>x</p>"))[1] == [("Bold", "x")]
    assert pages.parse_page(chain.format("<p>only</p>"))[1] == [("T", "only")] and pages.parse_page("<p>bare</p>")[1] == [("", "bare")]
    noted = spark.createDataFrame([(1, chain.format('<div class="fnlist"><p>0<br>↑ a<br>b</p><p>↑c</p></div>')), (2, None), (3, "<p>x</p>")], "page_id int, html string").withColumn("no", F.lit(0))
    assert [tuple(r) for r in pages.notes(noted, "page_id", "html").orderBy("no").collect()] == [(1, 1, "a b"), (1, 2, "c")]
    assert one(spark, pages.plain(F.lit('a<br>b<span class="pagenum">3</span><b>c</b>'))) == "a\nbc"


def test_extraction(spark):
    text = F.lit("## Word meanings\n* అ = one\n- ఆ: two; అ = three\n\n## Meaning (Telugu)\nభావం ఇది.\n\n**English**: Done.\n")
    assert one(spark, extract.gloss(extract.section(text, "Word"))) == {"ఆ": "two", "అ": "three"}
    assert one(spark, extract.section(text, "Telugu")) == "భావం ఇది."
    assert one(spark, extract.section(text, "Nothing")) is None
    both = one(spark, extract.two_languages(F.lit("భావం\n(An English line)\nMore")))
    assert both.telugu == "భావం" and both.english == "(An English line) More"
    assert one(spark, extract.quoted_letter(F.lit("2nd Letter 'ల' matches 'ళ'."), 2)) == "ళ"
    assert one(spark, extract.foot_name_list(F.lit("x (Nala - IIII - Indra) | y (Ha/Gala - UI - Surya)"))) == ["Nala", "Ha/Gala"]
    assert one(spark, extract.foot_pattern_list(F.lit("x (Nala - IIII - Indra) | y (Ha/Gala - UI - Surya)"))) == ["IIII", "UI"]
    assert one(spark, extract.replace_nth_letter(F.lit("a క ఖ గ"), 2, F.lit("జ"))) == "a క జ గ"
    assert one(spark, extract.replace_nth_letter(F.lit("క"), 2, F.lit("జ"))) == "క"
    assert one(spark, extract.rolling_hash(F.lit("ab"))) == "id-" + format(97 * 31 + 98, "x")
    assert one(spark, extract.jaccard(F.array(), F.array())) == 1.0
    assert one(spark, extract.longest_run(F.lit("UIIU"), F.lit("IIUU"))) == 3
    assert one(spark, extract.bigrams(F.lit("UIU"))) == ["UI", "IU"]


def test_cleaning(spark):
    assert one(spark, cleaning.clean_line(F.lit(" అ,  ఆ! (ఇ) 12 "), trailing_digits=True)) == "అ ఆ ఇ"
    assert one(spark, cleaning.clean_line(F.lit("# key: v."))) == "# key: v"
    assert one(spark, cleaning.clean_line(F.lit("a-b:"), extra="-")) == "ab"
    assert len(cleaning.REMOVED) == 25
    names = {" Palle-Patalu ": "palle_patalu", "x/": "x", "A B.txt": "a_b", "": "unknown", None: "unknown"}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "k string, v string")
    assert all(r.v == r.g for r in df.select("v", clean_source(F.col("k")).alias("g")).collect())


def test_lines(spark):
    text = "# a: 1\n# a: 2\n# b: x: y\nఅ ఆ\nఇ [n] ఈ\n\nఉ ఊ\nఎ ఏ\nఒ ఓ\n# head\nక\n\nబ....\nభ\n---\nగ\nఘ"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "---")], "id int, text string")
    got = [(r.couplet_number, r.line1, r.line2) for r in lines.couplets(df, "id", "text").orderBy("couplet_number").collect()]
    assert got == [(1, "అ ఆ", "ఇ  ఈ"), (2, "ఉ ఊ", "ఎ ఏ"), (3, "ఎ ఏ", "ఒ ఓ")]
    c = lines.counters(df, "id", "text").first()
    assert (c.singletons, c.triplets, c.couplets, c.discarded) == (1, 1, 3, 1)
    h = {r.id: r.headers for r in lines.headers(df, "id", "text").collect()}
    assert h[1] == {"a": "2", "b": "x: y"} and h[3] == {}


def test_scripts(spark):
    assert one(spark, scripts.telugu_to_kannada(F.lit("తెలుగు abc క్ష"))) == "ತೆಲುಗು abc ಕ್ಷ"
    assert one(spark, scripts.kannada_to_telugu(scripts.telugu_to_kannada(F.lit(scripts.TELUGU)))) == scripts.TELUGU
    assert len(scripts.TELUGU) >= 78
    assert one(spark, scripts.quality(F.lit("abc"))) is None


def test_quotas_and_choice(spark):
    assert sorted(curate.quotas({c: 1000 for c in "abcdef"}, 250).values()) == [41, 41, 42, 42, 42, 42]
    assert curate.quotas({"a": 3, "b": 100, "c": 100}, 53) == {"a": 3, "b": 25, "c": 25}
    assert curate.quotas({"a": 1}, 10) == {"a": 1}
    df = spark.range(2000).select("id", F.when(F.col("id") < 20, "s").otherwise("l").alias("g"))
    s = {r.g: r["count"] for r in curate.stratified(df, "g", "id", 100, 1).groupBy("g").count().collect()}
    assert s == {"s": 20, "l": 80}
    sizes = {r.split: r["count"] for r in curate.exact_splits(df, "id", 3).groupBy("split").count().collect()}
    assert sizes == {"train": 1600, "val": 200, "test": 200}
    first = curate.first_wins(spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 1)], "id int, k string, o int"), "k", "o", "id")
    assert {r.id for r in first.collect()} == {2, 3, 4}


def test_salvage_and_results(spark, tmp_path):
    text = 'x {"a": {"b": "}", "c": [1]}, "d": {}} y {"e": 1} z {"f": {"g": 2}'
    assert one(spark, letters.salvaged_objects(F.lit(text))) == ['{"a": {"b": "}", "c": [1]}, "d": {}}', '{"e": 1}', '{"g": 2}']
    df = spark.createDataFrame([("train", "x"), ("train", "y"), ("test", None)], "split string, p string")
    formats.save_results(df, str(tmp_path / "r"), level="2")
    meta, back = formats.load_results(spark, str(tmp_path / "r"))
    assert meta == {"level": "2"} and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert {(r.split, r.n): r.pct for r in formats.split_stats(df).collect()} == {("train", 2): 66.6667, ("test", 1): 33.3333}
