"""Records of evaluation splits that occur again, exactly or almost, in the training split.

The words of every text stand in one global order, rarest first, so that their order in the text
does not count, and the suffixes of these sequences are sorted and compared across the splits. Two texts
that differ in at most a fifth of their words share one of their rarest words: of ``n`` words
the first ``n / 5 + 1`` are kept, and the first common word of a pair is among those of both. So
only the suffixes that begin at a kept word are needed, and suffixes with a common prefix of one word or
more meet. A word that very many records keep is combined with the kept words of the instruction,
of which a pair shares one as well. So every pair meets, without a cap; kept words of the
instruction and numbers of words then rule out most, by bounds that are exact. Words run together
count as their parts and as the whole. Equal records are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hotkeys import HOT_ROWS, hot_keys, join_hot, small
from ..scratch import drop, materialise
from .neardup import near
from .rarest import first_words, ordered, slices, vocabulary
from .textfold import folded_words

_U = np.uint64
#: Largest share of changed words in either field: one in PART.
CHANGED, PART = 1 / 5, 5
#: Records that keep one word of the output, from which it is combined with the words of the instruction.
BOILERPLATE = 256
#: Kept words that a pair must share at least, of as many more that are compared.
SHARED = 4
#: Kept words up to which those of both splits are broadcast: some megabytes.
KEYS = 1_000_000


def _texts(df: DataFrame, id_col: str, a_col: str, b_col: str, split_col: str, train: str) -> DataFrame:
    """``id``, ``train``, ``class_key``, folded words ``a`` and ``b``; rows without words in either field or without a split are left out."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("train", T.BooleanType()), T.StructField("class_key", T.BinaryType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                wa, wb = folded_words(a or ""), folded_words(b or "")
                if wa and wb:
                    key = hashlib.blake2b("\x00".join(sorted(wa) + [""] + sorted(wb)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((i, t, key, " ".join(wa), " ".join(wb)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(zip(*rows), (batch.column(0).type, pa.bool_(), pa.binary(), pa.string(), pa.string()))], names=schema.names)

    part = df.filter(F.col(split_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(split_col) == train).alias("t"), F.col(a_col).cast("string").alias("a"), F.col(b_col).cast("string").alias("b"))
    return part.mapInArrow(run, schema)


def kept_words(texts: list[str], field: int, rarity: np.ndarray, parts: np.ndarray, lengths: np.ndarray) -> tuple[pa.ListArray, dict[str, np.ndarray]]:
    """Hashes of the rarest words of each text, as many as can be changed, and :data:`SHARED`; and numbers for each text.

    ``k``: how many are kept: as many as can be changed, and one. ``n``, ``m``: words as written, and with those
    run together parted. ``s``: how many of the hashes it shares with any text near it, at least, even
    if only their upper halves are compared and some of the text are equal there.
    """
    of, element, told = ordered(texts, field, CHANGED, rarity, parts, lengths)
    size, keep = told["size"], told["keep"]
    first, lists = first_words(of, element, size, np.minimum(size, keep - 1 + SHARED))
    left, element = of[first], element[first]
    again = np.bincount(left, minlength=len(texts)) - np.bincount(np.unique(left.astype(_U) << _U(32) | element >> _U(32)).astype(np.int64) >> 32, minlength=len(texts))
    numbers = {"k": np.minimum(keep, size), "n": told["n"], "m": told["m"], "s": np.maximum(np.minimum(size - keep + 1, SHARED) - again, 0)}
    return lists, numbers


def _firsts(lists: pa.ListArray, n: np.ndarray) -> pa.ListArray:
    """The first ``n`` elements of each list."""
    start = lists.offsets.to_numpy()[:-1]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(start, n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), type=pa.int32()), lists.values.take(pa.array(at)))


def _may_be_near(field: str) -> Column:
    """Numbers of words and rarest words of a field let at most a fifth be changed, whatever words are run together."""
    e, t = (lambda c: F.col(f"e_{c}_{field}")), (lambda c: F.col(f"t_{c}_{field}"))
    limit = F.greatest(e("n"), t("n")) * F.lit(CHANGED) + F.lit(1e-9)
    shared = F.size(F.array_intersect(F.col(f"e_x{field}"), F.col(f"t_x{field}"))) >= F.least(e("s"), t("s"))
    return (e("n") - t("m") <= limit) & (t("n") - e("m") <= limit) & shared


def _met(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs ``e`` (evaluation side), ``t`` (training side) of classes that share kept words and may be near."""
    tables = rows.sparkSession.sparkContext.broadcast(vocabulary(rows))
    told = [f"{c}_{field}" for field in "ab" for c in "knms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            (xa, na), (xb, nb) = (kept_words(batch.column(2 + field).to_pylist(), field, *tables.value) for field in (0, 1))
            numbers = [pa.array(x[c], type=pa.int32()) for x in (na, nb) for c in "knms"]
            short = [pa.ListArray.from_arrays(x.offsets, pa.array((x.values.to_numpy() >> 32).astype(np.int32))) for x in (xa, xb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *short, _firsts(xb, nb["k"])], names=["class", "sides", *told, "xa", "xb", "kb"])

    kind = reps.schema["class"].dataType.simpleString()
    kept = reps.select("class", "sides", "a", "b").mapInArrow(run, f"class {kind}, sides tinyint, {', '.join(f'{c} int' for c in told)}, xa array<int>, xb array<int>, kb array<bigint>")
    kept = materialise(kept, "kept")
    sides = [F.sum(F.col("sides").bitwiseAND(F.lit(s)).cast("boolean").cast("long")) for s in (1, 2)]
    firsts = F.explode("kb").alias("key")
    counts = kept.select("sides", firsts).groupBy("key").agg(sides[0].alias("nt"), sides[1].alias("ne"))
    # only words with both splits
    counts = materialise(counts.filter("nt > 0 and ne > 0").select("key", (F.col("nt") + F.col("ne") >= BOILERPLATE).alias("wide")), "counts")
    suffixes = kept.select(*[c for c in kept.columns if c not in ("kb", "k_b")], firsts)
    narrow = suffixes.join(small(counts.filter("not wide").select("key"), KEYS), "key", "left_semi")
    both = suffixes.join(small(counts.filter("wide").select("key"), KEYS), "key", "left_semi")
    both = both.withColumn("k2", F.explode(F.slice("xa", F.lit(1), F.col("k_a")))).withColumn("key", F.xxhash64("key", "k2")).drop("k2")

    def meet(keys: DataFrame, hot: DataFrame | None) -> DataFrame:
        def side(bit: int, name: str) -> DataFrame:
            cols = [F.col(c).alias(f"{name}_{c}") for c in (*told, "xa", "xb") if c[0] != "k"]
            return keys.filter(F.col("sides").bitwiseAND(F.lit(bit)) > 0).select("key", F.col("class").alias(name), *cols)

        pairs = join_hot(side(2, "e"), side(1, "t"), ["key"], hot).filter(F.col("e") != F.col("t"))
        return pairs.filter(_may_be_near("a") & _may_be_near("b")).select("e", "t")

    # exact counts: a hot key's evaluation rows get one salt each, its training rows all of them
    n_both = materialise(both.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS), "hot")
    out = materialise(meet(narrow, None).unionByName(meet(both, hot_keys(n_both, ["key"], hot_rows=HOT_ROWS))).distinct(), "met")
    drop(kept, counts, n_both)
    return out


@F.pandas_udf(T.BooleanType())
def _both_near(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
    return pd.Series([near(p, q, CHANGED) and near(r, s, CHANGED) for p, q, r, s in zip(a1, a2, b1, b2)], dtype=bool)


class Overlaps:
    """Classes of equal records, their members, and links between classes across the splits; only :meth:`pairs` lists every two records."""

    def __init__(self, df: DataFrame, id_col: str, a_col: str, b_col: str, split_col: str, train: str = "train"):
        self.rows = rows = materialise(_texts(df, id_col, a_col, b_col, split_col, train), "overlap")
        number = lambda c: F.sum(c.cast("long"))
        counted = rows.groupBy("class_key").agg(F.min("id").alias("class"), number(F.col("train")).alias("n_train"), number(~F.col("train")).alias("n_eval"))
        #: ``class`` (smallest identifier), ``n_train``, ``n_eval``
        self.classes = materialise(counted.withColumn("n", F.col("n_train") + F.col("n_eval")), "classes")
        hot = hot_keys(self.classes, ["class_key"], hot_rows=HOT_ROWS)
        #: ``class``, ``id``, ``train``
        self.members = materialise(join_hot(rows.select("class_key", "id", "train"), self.classes.select("class_key", "class"), ["class_key"], hot).select("class", "id", "train"), "members")

    def links(self) -> DataFrame:
        """``e``, ``t``: classes with an evaluation record and with a training record that nearly agree in both fields; a class of both splits is linked with itself."""
        rows, classes, members = self.rows, self.classes, self.members
        # one record stands for its class; only the classes of several records need to be looked up for that
        others = small(materialise(members.filter("id <> class").select("id"), "others"))
        bits = (F.when(F.col("n_train") > 0, 1).otherwise(0) + F.when(F.col("n_eval") > 0, 2).otherwise(0)).cast("tinyint").alias("sides")
        several = small(materialise(classes.filter("n > 1").select(F.col("class").alias("id"), bits), "several"))
        own = F.when(F.col("train"), F.lit(1)).otherwise(F.lit(2)).cast("tinyint")
        reps = rows.select("id", "train", "a", "b").join(others, "id", "left_anti").join(several, "id", "left").select(F.col("id").alias("class"), F.coalesce("sides", own).alias("sides"), "a", "b")
        met = _met(rows, reps)
        text = lambda c: rows.select("id", "a", "b").join(small(materialise(met.select(F.col(c).alias("id")).distinct(), "ids")), "id", "left_semi")
        pairs = met.join(text("e").toDF("e", "a1", "b1"), "e").join(text("t").toDF("t", "a2", "b2"), "t")
        same = classes.filter("n_train > 0 and n_eval > 0").select(F.col("class").alias("e"), F.col("class").alias("t"))
        out = materialise(pairs.filter(_both_near("a1", "a2", "b1", "b2")).select("e", "t").unionByName(same), "links")
        drop(met)
        return out

    def pairs(self) -> DataFrame:
        """``eval_id``, ``train_id`` of every two records of linked classes."""
        hot = hot_keys(self.classes, ["class"], hot_rows=HOT_ROWS)
        ev = self.members.filter("not train").select(F.col("class").alias("e"), F.col("id").alias("eval_id"))
        tr = self.members.filter("train").select(F.col("class").alias("t"), F.col("id").alias("train_id"))
        half = join_hot(ev, self.links(), ["e"], hot)
        return join_hot(half, tr, ["t"], hot).select("eval_id", "train_id")

    def counts(self) -> DataFrame:
        """``eval_id``, ``n_train``: evaluation records that occur again and the number of training records they are found in, from the class sizes."""
        sizes = self.classes.select(F.col("class").alias("t"), "n_train")
        n = self.links().join(sizes, "t").groupBy("e").agg(F.sum("n_train").alias("n_train"))
        hot = hot_keys(self.classes, ["class"], hot_rows=HOT_ROWS)
        ev = self.members.filter("not train").select(F.col("class").alias("e"), F.col("id").alias("eval_id"))
        return join_hot(ev, n, ["e"], hot).select("eval_id", "n_train")


def split_overlaps(df: DataFrame, id_col: str, a_col: str, b_col: str, split_col: str, train: str = "train") -> DataFrame:
    """``eval_id``, ``train_id`` of every pair across the training split that nearly agrees in both text fields.

    Order, blanks, punctuation and case of the words do not count; a fifth of the words of either
    field may be changed. Records with a null or blank field or a null split give no pair. Repeated
    rows each give their pairs; an empty table gives none.
    """
    return Overlaps(df, id_col, a_col, b_col, split_col, train).pairs()
