"""Near-duplicate records with small edits in two text fields.

Two texts that are near share one of their rarest words (:mod:`.rarest`), in either field. Classes meet
by such a word of the first field, and by it and one of the second where very many classes keep it, so
every pair meets, without a cap. A pair leaves the join only if the words that each lacks are not too many,
told by a bit for each word: that rules out nearly all others and no pair. Then come exact
verification and union-find grouping by connected components. Exact copies are one class from
the start, so a group of copies costs one row in every later step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rarest import first_words, ordered, slices, vocabulary
from .textfold import folded_words
from ..scratch import drop, materialise
from .components import connected_components
from ..operators.hotkeys import HOT_ROWS, hot_keys, join_hot, small

#: Classes that keep one word of the first field, from which it is combined with the words of the second.
WIDE = 256
#: Classes of one first field from which they are kept from meeting each other; rows from which a key is spread; buckets of the first count.
POPULAR, HOT_BAND, BUCKETS = 200, 2000, 1 << 18
#: Words or identifiers up to which they are broadcast: some megabytes.
KEYS = 1_000_000
#: Largest shares of changed words in the two fields.
CHANGED_A, CHANGED_B = 3 / 8, 1 / 7


def _digest(*parts: str) -> bytes:
    import hashlib

    return hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def folded(df: DataFrame, id_col: str, a_col: str, b_col: str) -> DataFrame:
    """``id``, ``class_key``, ``letters_key``, folded words ``a``, ``b``. Rows with a null or blank field are left out."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("class_key", T.BinaryType()), T.StructField("letters_key", T.BinaryType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                wa, wb = folded_words(a or ""), folded_words(b or "")
                if wa and wb:
                    rows.append((i, _digest("".join(wa), " ".join(sorted(wb))), _digest("".join(wa)), " ".join(wa), " ".join(wb)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(cols, (batch.column(0).type, pa.binary(), pa.binary(), pa.string(), pa.string()))], names=schema.names)

    return df.select(F.col(id_col).alias("i"), F.col(a_col).cast("string").alias("a"), F.col(b_col).cast("string").alias("b")).mapInArrow(run, schema)


def rare_words(texts: list[str], field: int, share: float, *tables: np.ndarray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """Hashes of the rarest words of each text, one of which any text near it has among its own; a bit for each of its words; and how many it may lack."""
    of, element, told = ordered(texts, field, share, *tables)
    _, lists = first_words(of, element, told["size"], np.minimum(told["size"], told["keep"]))
    bits = np.zeros(len(texts), dtype=np.uint64)
    np.bitwise_or.at(bits, of, np.uint64(1) << (element >> np.uint64(58)))
    return lists, bits, told["keep"] - 1


def kept(texts: DataFrame) -> DataFrame:
    """``id``, ``class_key``, ``letters_key`` of texts with ``a``, ``b`` and, for both fields, ``k`` (hashes of the rarest words), ``bits`` and ``lack`` of :func:`rare_words`."""
    tables = texts.sparkSession.sparkContext.broadcast(vocabulary(texts))
    keys = ("id", "class_key", "letters_key")
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            cols = list(batch.columns[:3])
            for field, share in enumerate((CHANGED_A, CHANGED_B)):
                lists, bits, lack = rare_words(batch.column(3 + field).to_pylist(), field, share, *tables.value)
                cols += [lists, pa.array(bits.view(np.int64)), pa.array(lack, type=pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "k_a", "bits_a", "lack_a", "k_b", "bits_b", "lack_b"])

    return texts.select(*keys, "a", "b").mapInArrow(run, f"{kinds}, k_a array<bigint>, bits_a bigint, lack_a int, k_b array<bigint>, bits_b bigint, lack_b int")


def _may_be_near(fields: str = "ab") -> Column:
    """The words of ``l`` that ``r`` lacks are not too many, nor the reverse, in ``fields``: words that are lacking have at least as many as their bits."""
    out = F.lit(True)
    for f in fields:
        x, y = F.col(f"l_bits_{f}"), F.col(f"r_bits_{f}")
        out &= F.bit_count(x.bitwiseAND(F.bitwise_not(y))) <= F.col(f"l_lack_{f}")
        out &= F.bit_count(y.bitwiseAND(F.bitwise_not(x))) <= F.col(f"r_lack_{f}")
    return out


def changed_words(x: list[str], y: list[str]) -> int:
    """Words replaced, added or lost between two texts; order does not count, nor words run together."""
    left: dict[str, int] = {}
    for w in x:
        left[w] = left.get(w, 0) + 1
    extra: dict[str, int] = {}
    n_left, n_extra = len(x), 0
    for w in y:
        k = left.get(w, 0)
        if k:
            left[w] = k - 1
            n_left -= 1
        else:
            extra[w] = extra.get(w, 0) + 1
            n_extra += 1
    if n_left and n_extra:
        a = {w: k for w, k in left.items() if k}
        if _may_join(a, extra) or _may_join(extra, a):
            a, b = Counter(a), Counter(extra)
            _unjoin(x, a, b)
            _unjoin(y, b, a)
            return max(a.total(), b.total())
    return max(n_left, n_extra)


def _may_join(parts: dict[str, int], wholes: dict[str, int]) -> bool:
    """Some word begins with one of the parts."""
    return any(w[:k] in parts for w in wholes for k in range(1, len(w)))


def _unjoin(words: list[str], rest: Counter, other: Counter) -> None:
    """Take out neighbours left in ``rest`` whose concatenation is a word left in ``other``."""
    longest = max(map(len, other), default=0)
    for i in range(len(words) - 1):
        if not rest[words[i]]:
            continue
        joined, j = words[i], i + 1
        while j < len(words) and rest[words[j]] and len(joined) < longest:
            joined += words[j]
            j += 1
            if other[joined]:
                other[joined] -= 1
                rest.subtract(words[i:j])
                break
    for c in (rest, other):
        for w in [w for w, k in c.items() if k <= 0]:
            del c[w]


def near(x: str, y: str, share: float) -> bool:
    """At most ``share`` of the longer text's words are changed."""
    a, b = x.split(" "), y.split(" ")
    return changed_words(a, b) <= share * max(len(a), len(b)) + 1e-9


@F.pandas_udf(T.BooleanType())
def _both_near(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
    return pd.Series([near(p, q, CHANGED_A) and near(r, s, CHANGED_B) for p, q, r, s in zip(a1, a2, b1, b2)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _same_and_near(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
    return pd.Series([p.replace(" ", "") == q.replace(" ", "") and near(r, s, CHANGED_B) for p, q, r, s in zip(a1, a2, b1, b2)], dtype=bool)


#: What a key carries of its class.
_TOLD = ("id", "bits_a", "lack_a", "bits_b", "lack_b")


def _keyed(reps: DataFrame, wide: DataFrame, *more: str) -> DataFrame:
    """``key``, what it carries and the columns ``more``, for each rare word of the first field, and for each with one of the second if it is ``wide``."""
    words = reps.select(*more, *_TOLD, "k_b", F.explode("k_a").alias("key"))
    words = words.join(small(wide.withColumn("wide", F.lit(True)), KEYS), "key", "left")
    keys = F.when(F.col("wide"), F.transform("k_b", lambda k: F.xxhash64("key", k))).otherwise(F.array("key"))
    return words.select(F.explode(keys).alias("key"), *_TOLD, *more)


class NearDuplicates:
    """Stages of the operator over one table; each is made once.

    The result is the classes of exact copies with their sizes, their members, and links between
    classes; only :meth:`pairs` lists every two records.
    """

    def __init__(self, df: DataFrame, id_col: str, a_col: str, b_col: str):
        self.rows = materialise(folded(df, id_col, a_col, b_col), "neardup")
        reps = self.rows.groupBy("class_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        self.classes = materialise(reps, "classes")
        #: class members; the join with the classes is by key, its hot keys are spread
        hot = hot_keys(self.classes, ["class_key"], hot_rows=HOT_ROWS)
        self.members = join_hot(self.rows.select("class_key", "letters_key", "id"), self.classes.select("class_key", "rep"), ["class_key"], hot)
        #: of the classes, :func:`kept` under the identifier of one record
        self.reps = materialise(kept(self.rows).join(self.classes.select("class_key", F.col("rep").alias("id")), ["class_key", "id"], "left_semi").drop("class_key"), "kept")

    def candidates(self) -> DataFrame:
        """Distinct pairs of class representatives that share rare words and may be near.

        Two records of one first field are no pair. Those of a first field that many classes have
        would still meet each other, so they meet the others and, by groups
        of equal first fields, one another.
        """
        popular = self.reps.groupBy("letters_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= POPULAR)
        popular = materialise(popular.select("letters_key"), "popular")
        wide = self.reps.select(F.explode("k_a").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= WIDE)
        wide = materialise(wide.select("key"), "wide")
        if popular.isEmpty():
            return self._meet(_keyed(self.reps, wide)).distinct()
        cold = _keyed(self.reps.join(small(popular), "letters_key", "left_anti"), wide)
        many = materialise(_keyed(self.reps.join(small(popular), "letters_key", "left_semi"), wide, "letters_key"), "many")
        groups = many.select("key", "letters_key").distinct()
        two = groups.toDF("key", "lx").join(groups.toDF("key", "ly"), "key").filter("lx < ly")
        side = lambda name, letters: many.select("key", F.col("letters_key").alias(letters), *[F.col(c).alias(f"{name}_{c}") for c in _TOLD])
        among = two.join(side("l", "lx"), ["key", "lx"]).join(side("r", "ly"), ["key", "ly"])
        among = among.filter(_may_be_near()).select(F.col("l_id").alias("x"), F.col("r_id").alias("y"))
        out = self._meet(cold).union(self._meet(cold, many)).union(among)
        return out.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def _meet(self, left: DataFrame, right: DataFrame | None = None, fields: str = "ab") -> DataFrame:
        """``x``, ``y`` of equal key that may be near, ``x`` < ``y`` within one table; keys of many rows are spread."""
        hot = self._hot_bands(left)
        other = left if right is None else right
        side = lambda df, name: df.select("key", *[F.col(c).alias(f"{name}_{c}") for c in _TOLD])
        met = join_hot(side(left, "l"), side(other, "r"), ["key"], hot)
        if right is None:
            met = met.filter("l_id < r_id")
        return met.filter(_may_be_near(fields)).select(F.col("l_id").alias("x"), F.col("r_id").alias("y"))

    def _hot_bands(self, keys: DataFrame) -> DataFrame | None:
        """Keys of :data:`HOT_BAND` or more rows.

        Exact in two passes: keys are counted by :data:`BUCKETS` buckets, which merge on the map
        side, and only keys of buckets that reach the number are counted one by one.
        """
        bucket = F.pmod("key", F.lit(BUCKETS))
        full = materialise(keys.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_BAND).select("bucket"), "buckets")
        if full.isEmpty():
            return None
        counts = keys.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return hot_keys(materialise(counts.filter(F.col("n") >= HOT_BAND), "bands"), ["key"], hot_rows=HOT_BAND)

    def _alike(self) -> DataFrame | None:
        """Distinct pairs of class representatives with one first field whose second fields share a rare word and may be near."""
        several = self.reps.groupBy("letters_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        several = materialise(several.select("letters_key"), "several")
        if several.isEmpty():
            return None
        words = self.reps.join(small(several), "letters_key", "left_semi").select("letters_key", F.explode("k_b").alias("k"), *_TOLD)
        return self._meet(words.select(F.xxhash64("letters_key", "k").alias("key"), *_TOLD), fields="b").distinct()

    def _verified(self, pairs: DataFrame, are_near: Callable[..., Column]) -> DataFrame:
        """The pairs ``x``, ``y`` whose texts ``are_near``; only texts of their records move."""
        pairs = materialise(pairs, "met")
        ids = materialise(pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct(), "ids")
        text = materialise(self.rows.select("id", "a", "b").join(small(ids, KEYS), "id", "left_semi"), "texts")
        told = pairs.join(text.toDF("x", "a1", "b1"), "x").join(text.toDF("y", "a2", "b2"), "y")
        out = materialise(told.filter(are_near("a1", "a2", "b1", "b2")).select("x", "y"), "links")
        drop(pairs, ids, text)
        return out

    def links(self, alike: bool = True) -> DataFrame:
        """Verified pairs ``x`` < ``y`` of class representatives.

        Records of one first field belong to one group if their second fields are near, but are no
        pair: with ``alike`` false, classes of one first field are left out where they are many.
        """
        out = self._verified(self.candidates(), _both_near)
        more = self._alike() if alike else None
        return out if more is None else out.union(self._verified(more, _same_and_near)).distinct()

    def groups(self) -> DataFrame:
        """``id``, ``group_id`` (smallest identifier) of the records of groups with at least two records."""
        comp = connected_components(self.links().toDF("src", "dst"))
        of = self.classes.select("rep", "n").join(comp.toDF("rep", "group"), "rep", "left").select("rep", "n", F.coalesce("group", "rep").alias("group_id"))
        of = materialise(of, "groups")
        sizes = of.groupBy("group_id").agg(F.sum("n").alias("n_records")).filter("n_records > 1")
        of = of.join(sizes, "group_id").select("rep", "group_id", "n_records")
        return join_hot(self.members.select("rep", "id"), of, ["rep"], self._hot_classes()).select("id", "group_id", "n_records")

    def _hot_classes(self) -> DataFrame | None:
        return hot_keys(self.classes.select("rep", "n"), ["rep"], hot_rows=HOT_ROWS)

    def pairs(self) -> DataFrame:
        """``id_a`` < ``id_b``: every two records of linked classes whose first fields are not copies of each other."""
        links = self.links(alike=False)
        linked = links.select(F.col("x").alias("rep")).union(links.select(F.col("y").alias("rep"))).distinct()
        hot = self._hot_classes()
        m = materialise(join_hot(self.members, linked, ["rep"], hot).select("rep", "id", "letters_key"), "linked")
        left = join_hot(m.toDF("x", "id_x", "kx"), links, ["x"], hot)
        both = join_hot(left, m.toDF("y", "id_y", "ky"), ["y"], hot)
        return both.filter("kx <> ky").select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))
