"""Text, JSON and table formats of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prosody import strip

_S, _M = T.StringType(), T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINE_TEXT = _struct(breakdown=_S, yati_check=_S, prasa_check=_S)
COUPLET = _struct(poem=_S, line1=_S, line2=_S, source=_struct(work=_S, file=_S, couplet_number=T.IntegerType()), headers=_M)
RECORD = _struct(prompt=_S, poem=_S, word_to_word_meaning=_M, telugu_meaning=_S, english_meaning=_S, chandassu_analysis=_struct(line_1=LINE_TEXT, line_2=LINE_TEXT), source=_S, is_synthetic_data=T.BooleanType())
RAGALE = _struct(poem_kannada=_S, meaning_kannada=_S, meaning_english=_S, theme=_S, prasa_syllable=_S)
_PARTS = T.ArrayType(_struct(text=_S))
REQUEST = _struct(key=_S, request=_struct(contents=T.ArrayType(_struct(role=_S, parts=_PARTS))), metadata=_struct(source_file=_S, work=_S, couplet_number=T.IntegerType()))
RESPONSE = T.StructType([*REQUEST.fields, T.StructField("response", _struct(candidates=T.ArrayType(_struct(content=_struct(parts=_PARTS)))))])
TOKEN = _struct(token_id=T.IntegerType(), token_text=_S)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array or JSON lines: the first character of the first file decides, the schema is given."""
    head = spark.read.text(path).select(strip(F.col("value")).alias("v")).filter("v <> ''").head(1)
    return spark.read.schema(schema).option("multiLine", bool(head) and head[0].v.startswith("[")).json(path)


def read_texts(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """``path``, ``work`` (first folder under ``root``), ``text`` of every ``*.txt`` file below a folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    root = (root or path).rstrip("/")
    rel = F.regexp_replace(F.input_file_name(), rf"^.*{root.replace('file://', '')}/", "")
    return df.select(rel.alias("path"), F.split(rel, "/")[0].alias("work"), F.col("value").alias("text"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token table ``token_id``, ``token_text``, parted by tabs, without quoting."""
    return spark.read.schema(TOKEN).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def responses(df: DataFrame) -> DataFrame:
    """``key``, ``text`` of every response and ``reason`` where there is none, instead of an error."""
    text = F.get(F.get(F.col("response.candidates"), F.lit(0))["content"]["parts"], F.lit(0))["text"]
    reason = F.when(F.col("response").isNull(), "no response").when(F.size(F.coalesce("response.candidates", F.array())) == 0, "no candidates").when(text.isNull(), "no text")
    return df.select("key", text.alias("text"), reason.alias("reason"))


def requests(df: DataFrame, key: Column, prompt: Column, metadata: Column) -> DataFrame:
    """Batch requests: one user turn with one part each."""
    part = F.array(F.struct(prompt.alias("text")))
    return df.select(key.alias("key"), F.struct(F.array(F.struct(F.lit("user").alias("role"), part.alias("parts"))).alias("contents")).alias("request"), metadata.alias("metadata"))


def without_roles(df: DataFrame) -> DataFrame:
    """Requests in the batch format that knows no roles, keyed by work and number."""
    contents = F.transform(F.col("request.contents"), lambda c: F.struct(c["parts"].alias("parts")))
    return df.select(F.concat_ws("__", "metadata.work", "metadata.couplet_number").alias("key"), F.struct(contents.alias("contents")).alias("request"), "metadata")


def write_splits(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per split."""
    df.write.partitionBy("split").mode("overwrite").json(path)


def with_header(title: Column, headers: Column, body: Column) -> Column:
    """Text of a chapter file: ``# key: value`` lines, an empty line, the body."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit("# "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.array_join(lines, "\n"), F.lit(""), body)


def split_stats(df: DataFrame, *groups: str) -> DataFrame:
    """Records by split and the other columns given, with the share of each split in all."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    n = df.groupBy("split", *groups).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select("split", *groups, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 4).alias("pct"))


def save_results(df: DataFrame, path: str, **meta: str) -> None:
    """Results as parquet beside one JSON line of what is known about them."""
    df.write.mode("overwrite").parquet(f"{path}/results")
    df.sparkSession.createDataFrame([(meta,)], "meta map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_results(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """What :func:`save_results` wrote."""
    row = spark.read.schema("meta map<string,string>").json(f"{path}/meta").first()
    return dict(row.meta or {}) if row else {}, spark.read.parquet(f"{path}/results")
