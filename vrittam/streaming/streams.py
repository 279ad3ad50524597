"""Streaming and batch forms of the verse reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reader import VerseState, shape

STATE = "settled string, tail string, seen int, second string, lines string, rhymes string, firsts string"
#: Kannada letters to the Telugu ones at the same places of their block.
KANNADA = {cp: cp - 0x80 for cp in range(0xC80, 0xD00)}
OUT = "stream_id string, seq bigint, line_no int, weights string, alive boolean, accepts boolean"


def _advance(state: VerseState, stream: str, seq: int, chunk: str | None) -> tuple[VerseState, tuple]:
    state = state.feed(chunk or "")
    return state, (stream, seq, len(state.lines) + 1, state.line(), state.alive(), state.accepts())


def read_stream(chunks: DataFrame) -> DataFrame:
    """Every chunk (``stream_id``, ``seq``, ``chunk``) of a stream with the state of its line behind it.

    Keyed state of six short fields per stream; the chunks of a micro-batch are put in order of
    ``seq``. Null chunks are empty. A streaming DataFrame in, a streaming DataFrame out (append).
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = VerseState.from_row(state.get) if state.exists else VerseState()
        rows = []
        for r in pd.concat(list(pdfs)).sort_values("seq", kind="stable").itertuples():
            now, row = _advance(now, key[0], r.seq, r.chunk)
            rows.append(row)
        state.update(now.to_row())
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def read_lines(df: DataFrame, id_col: str, text_col: str, kannada: bool = False) -> DataFrame:
    """Batch form over whole texts: ``id``, weights of the finished lines joined by ``|``, and whether all are valid. With ``kannada`` its letters are read as the Telugu ones at their places. Narrow."""
    kind, letters = df.schema[id_col].dataType.simpleString(), KANNADA if kannada else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .reader import tables

        full = tables()[0]
        for pdf in batches:
            ends = [VerseState().feed((t or "").translate(letters) + "\n").lines for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["i"], "weights": ["|".join(x) for x in ends], "all_valid": [bool(x) and all(w in full for w in x) for x in ends]})

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, weights string, all_valid boolean")


@F.pandas_udf(T.StringType())
def _shape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: shape(x or ""))


@F.pandas_udf(T.StringType())
def _weight_state(s: pd.Series) -> pd.Series:
    """Settled weights and tail behind a shape, parted by a bar."""
    ends = {x: VerseState().feed(x) for x in set(s)}
    return s.map(lambda x: f"{ends[x].settled}|{ends[x].tail}")


def _living(states: DataFrame, shapes: list[str]) -> DataFrame:
    """``state``, ``shape``, ``accepts``: the shapes that keep a weight state alive. Shapes in their order share the states of what they begin with."""
    shared = states.sparkSession.sparkContext.broadcast(shapes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key in pdf["state"]:
                got = []
                settled, _, tail = key.partition("|")
                states, last = [VerseState(settled, tail)], ""
                for s in shared.value:
                    same = next((i for i, (x, y) in enumerate(zip(s, last)) if x != y), min(len(s), len(last)))
                    del states[same + 1 :]
                    for c in s[same:]:
                        states.append(states[-1].feed(c))
                    last = s
                    if states[-1].alive():
                        got.append((key, s, states[-1].accepts()))
                yield pd.DataFrame(got, columns=["state", "shape", "accepts"])

    return states.mapInPandas(run, "state string, shape string, accepts boolean")


def _masked_one_by_one(prefixes: DataFrame, rows: list[tuple]) -> DataFrame:
    """Living pairs where line ends, behind which rhyme letters count, are in the prefix or the token."""
    shared = prefixes.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["prefix"]:
                start = VerseState().feed(p or "")
                got = [(p, i, s.accepts()) for i, t in shared.value if (s := start.feed(t)).alive()]
                yield pd.DataFrame(got, columns=["prefix", "token_id", "accepts"])

    return prefixes.select("prefix").mapInPandas(run, "prefix string, token_id int, accepts boolean")


def token_mask(prefixes: DataFrame, tokens: DataFrame, max_tokens: int = 300_000) -> DataFrame:
    """``prefix``, ``token_id``, ``accepts``: the tokens after which a line begun with a prefix can still become valid.

    A vocabulary (``token_id``, ``token_text``) of more than ``max_tokens`` is refused. Only weights
    count inside a line: prefixes are masked by their different weight states and tokens by their
    different shapes, and joined to both again; only living pairs are made. Null texts are empty.
    """
    rows = tokens.select("token_id", "token_text").limit(max_tokens + 1).collect()
    if len(rows) > max_tokens:
        raise ValueError(f"more than {max_tokens} tokens")
    listed = [(r.token_id, r.token_text or "") for r in rows]
    text = F.coalesce("token_text", F.lit(""))
    inside = tokens.filter(~F.contains(text, F.lit("\n"))).select("token_id", _shape("token_text").alias("shape"))
    broken = F.contains(F.coalesce("prefix", F.lit("")), F.lit("\n"))
    plain = prefixes.filter(~broken).select("prefix", _weight_state(_shape("prefix")).alias("state"))
    lived = _living(plain.select("state").distinct(), sorted({shape(t) for _, t in listed if "\n" not in t}))
    by_shape = plain.join(lived, "state").join(F.broadcast(inside), "shape").select("prefix", "token_id", "accepts")
    one_by_one = _masked_one_by_one(prefixes.filter(~broken), [x for x in listed if "\n" in x[1]])
    return by_shape.unionByName(one_by_one).unionByName(_masked_one_by_one(prefixes.filter(broken), listed))


def alive_counts(prefixes: DataFrame, tokens: DataFrame, max_shapes: int = 300_000) -> DataFrame:
    """``prefix``, ``n_alive``: how many rows of ``tokens`` :func:`token_mask` gives for each prefix without line ends; none has no row.

    Prefixes share the work of their weight state, tokens that of their shape; only the shapes
    (refused beyond ``max_shapes``) go to every task. Tokens with line ends are masked one by one.
    """
    text = F.coalesce("token_text", F.lit(""))
    shaped = tokens.filter(~F.contains(text, F.lit("\n"))).groupBy(_shape("token_text").alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    rows = shaped.limit(max_shapes + 1).collect()
    if len(rows) > max_shapes:
        raise ValueError(f"more than {max_shapes} shapes of tokens")
    spark = prefixes.sparkSession
    counted = F.broadcast(spark.createDataFrame([(r.shape, r.n) for r in rows], "shape string, n bigint"))
    begun = prefixes.select("prefix", _weight_state(_shape("prefix")).alias("state"))
    lived = _living(begun.select("state").distinct(), sorted(r.shape for r in rows)).join(counted, "shape").groupBy("state").agg(F.sum("n").alias("n"))
    with_ends = tokens.filter(F.contains(text, F.lit("\n"))).select("token_text").limit(max_shapes + 1).collect()
    if len(with_ends) > max_shapes:
        raise ValueError(f"more than {max_shapes} tokens with line ends")
    broken = _masked_one_by_one(prefixes, [(0, r.token_text) for r in with_ends])
    every = begun.join(lived, "state").select("prefix", "n").unionByName(broken.select("prefix", F.lit(1).cast("long").alias("n")))
    return every.groupBy("prefix").agg(F.sum("n").alias("n_alive")).filter("n_alive > 0")


def script_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of Telugu letters, blanks and colons only."""
    return tokens.filter(F.col("token_text").rlike(r"^[\x{0C00}-\x{0C7F} \n:]+$"))


def prefix_states(df: DataFrame, id_col: str, text_col: str, kannada: bool = False) -> DataFrame:
    """``id``, ``line_no``, ``weights``, ``alive``, ``yati_alive``, ``accepts``: the state behind every text, read from its beginning. Narrow.

    Null texts are empty. With ``kannada`` its letters are read as the Telugu ones at their places.
    """
    kind, letters = df.schema[id_col].dataType.simpleString(), KANNADA if kannada else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [VerseState().feed((t or "").translate(letters)) for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["i"], "line_no": [len(x.lines) + 1 for x in s], "weights": [x.line() for x in s], "alive": [x.alive() for x in s], "yati_alive": [x.yati_alive() for x in s], "accepts": [x.accepts() for x in s]})

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, line_no int, weights string, alive boolean, yati_alive boolean, accepts boolean")


def masked_scores(scores: DataFrame, mask: DataFrame, end_token: int | None = None) -> DataFrame:
    """``scores`` (``prefix``, ``token_id``, ``score``) with minus infinity for the tokens that the mask of a prefix lacks.

    A prefix of which no scored token is in the mask keeps its scores. ``end_token`` keeps its score
    behind prefixes with a token that completes the line.
    """
    living = mask.select("prefix", "token_id").distinct().withColumn("_in", F.lit(True))
    got = scores.join(living, ["prefix", "token_id"], "left")
    if end_token is not None:
        done = mask.filter("accepts").select("prefix").distinct().withColumn("_done", F.lit(True))
        got = got.join(done, "prefix", "left").withColumn("_in", F.when((F.col("token_id") == end_token) & F.col("_done"), True).otherwise(F.col("_in"))).drop("_done")
    some = got.groupBy("prefix").agg(F.max(F.coalesce("_in", F.lit(False))).alias("_some"))
    got = got.join(some, "prefix")
    return got.withColumn("score", F.when(F.coalesce("_in", F.lit(False)) | ~F.col("_some"), F.col("score")).otherwise(F.lit(float("-inf")))).drop("_in", "_some")
