"""Words of texts in one global order, rarest first, and the rarest of each text.

Of a text that may lack ``k - 1`` of its words in any text near it, the first ``k`` in that order hold
one that both have, and it is among the first of the other as well: so near texts meet by them, none is
missed. Words run together count as their parts and as the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, materialise
from .superminhash import mix

_U = np.uint64
#: Bits of the table of word counts that orders the words. Words of one place only cost time.
PLACE_BITS = 22
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class _Words(dict):
    """Rolling hashes of words, kept for a bounded number of them."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = 0
        for c in w:
            h = (h * _BASE + ord(c) + 1) & _MASK
        self[w] = h
        return h


_HASH = _Words()


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hash, letters and index of the text of every word."""
    words = " ".join(texts).split(" ") if texts else []
    of = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 for t in texts])
    return np.fromiter(map(_HASH.__getitem__, words), dtype=_U, count=len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)), of


def _nth(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many equal hashes of the same text stand before each."""
    both = mix(h ^ mix(of))
    order = np.argsort(both, kind="stable")
    both = both[order]
    new = np.concatenate(([True], both[1:] != both[:-1])) if len(h) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    out = np.empty(len(h), dtype=_U)
    out[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return out


def _joins(h: np.ndarray, size: np.ndarray, of: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Neighbouring words run together to one of ``lengths`` letters: index of the text, number of words, rolling hash."""
    if not len(h):
        return
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([_U(1)], np.full(size.max(), _U(_BASE), dtype=_U))))
    at, whole, length, k = np.arange(len(h)), h, size, 2
    longest = len(lengths) - 1
    while True:
        ok = (length < longest) & (at + k - 1 < len(h))
        at, whole, length = at[ok], whole[ok], length[ok]
        ok = of[at + k - 1] == of[at]
        at, whole, length = at[ok], whole[ok], length[ok]
        if not len(at):
            return
        last = at + k - 1
        with np.errstate(over="ignore"):
            whole = whole * power[size[last]] + h[last]
        length = length + size[last]
        hit = lengths[np.minimum(length, longest)] & (length <= longest)
        if hit.any():
            yield of[at[hit]], k, whole[hit]
        k += 1


def _word_id(h: np.ndarray, field: int) -> np.ndarray:
    return mix(h ^ _U(field))


def _place(word: np.ndarray) -> np.ndarray:
    return (word >> _U(64 - PLACE_BITS)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _counted(found: DataFrame, size: int, kind: type) -> np.ndarray:
    """A table of ``place``, ``n`` as an array; it has at most ``size`` rows, whatever the input."""
    got = found.toArrow()
    out = np.zeros(size, dtype=kind)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def vocabulary(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rarity of the words by place, most parts of which a word at a place is run together (0: none), and the lengths of words."""
    spark = rows.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in (0, 1):
                h, size, _ = _flat(batch.column(field).to_pylist())
                w, at, n = np.unique(_word_id(h, field), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n), pa.array(size[at])], names=["w", "n", "len"])

    place = F.shiftrightunsigned("w", 64 - PLACE_BITS).alias("place")
    said = rows.select("a", "b").mapInArrow(words, "w bigint, n bigint, len bigint")
    vocab = materialise(said.groupBy("w").agg(F.sum("n").alias("n"), F.max("len").alias("len")), "vocabulary")
    rarity = _counted(vocab.groupBy(place).agg(F.least(F.ceil(F.log2(F.sum("n")) * 4) + 1, F.lit(255)).cast("smallint").alias("n")), 1 << PLACE_BITS, np.uint8)
    sizes = [r["len"] for r in vocab.select("len").distinct().collect()]
    lengths = np.zeros(max(sizes, default=0) + 1, dtype=bool)
    lengths[sizes] = True
    known = spark.sparkContext.broadcast((rarity, lengths))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, lengths = known.value
        for batch in slices(batches, 2000):
            for field in (0, 1):
                for _, k, whole in _joins(*_flat(batch.column(field).to_pylist()), lengths):
                    w = np.unique(_word_id(whole, field))
                    w = w[rarity[_place(w)] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), k, dtype=np.int32))], names=["w", "k"])

    wholes = rows.select("a", "b").mapInArrow(joined, "w bigint, k int").groupBy("w").agg(F.max("k").alias("k")).join(vocab.select("w"), "w", "left_semi")
    parts = _counted(wholes.groupBy(place).agg(F.max("k").alias("n")), 1 << PLACE_BITS, np.int32)
    drop(vocab)
    # a worker gets half as much unless a word has very many parts
    return rarity, parts if parts.max() > np.iinfo(np.int16).max else parts.astype(np.int16), lengths


def ordered(texts: list[str], field: int, share: float, rarity: np.ndarray, parts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Index of the text and hash of every word, rarest first within a text; and numbers for each text.

    ``size``: its hashes. ``keep``: as many as it may lack in a text near it, where ``share`` of the words
    may be changed, and one. ``n``, ``m``: words as written, and with those run together parted.

    A repeated word counts as several, numbered. Neighbours that stand run together somewhere are a
    word besides; then the text may lack that word and all its parts. A word that stands in parts
    somewhere lengthens the other text, and so the number of changed words.
    """
    h, size, of = _flat(texts)
    word = _word_id(h, field)
    said = np.bincount(of, minlength=len(texts))
    most = said + np.bincount(of, weights=np.maximum(parts[_place(word)].astype(np.int64) - 1, 0), minlength=len(texts)).astype(np.int64)
    keep = np.floor(most * share + 1e-9).astype(np.int64) + 1
    words, ofs = [word], [of]
    for t, k, whole in _joins(h, size, of, lengths):
        w = _word_id(whole, field)
        ok = parts[_place(w)] >= k
        words.append(w[ok])
        ofs.append(t[ok])
        keep += (k + 1) * np.bincount(t[ok], minlength=len(texts))
    word, of = np.concatenate(words), np.concatenate(ofs)
    element = mix(word ^ mix(_nth(of, word)))
    order = np.lexsort((element, of * 256 + rarity[_place(word)]))
    of, element = of[order], element[order]
    return of, element, {"size": np.bincount(of, minlength=len(texts)), "keep": keep, "n": said, "m": most}


def first_words(of: np.ndarray, element: np.ndarray, size: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The first ``upto`` hashes of each text of :func:`ordered`: whether each is among them, and the lists."""
    rank = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    first = rank < upto[of]
    offsets = np.concatenate(([0], np.cumsum(upto)))
    return first, pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(element[first].view(np.int64)))
