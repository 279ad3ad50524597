"""Encoding of whole texts with a public byte-level BPE tokenizer.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, for every
merge result is itself a token. Between such bytes a text is cut, the fragments are encoded on
their own and their ids joined. Fragments recur, so each worker keeps the ids of the ones it met.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; the variable is for places where they lie elsewhere.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT_TOKENIZER = "byte_bpe_50k"
#: The split pattern that belongs to the byte-level vocabularies, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments whose ids a worker keeps, and the longest kept one.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: Texts whose ids are put into one Arrow batch.
ROWS_OUT = 400

# Unicode White_Space, which is what \s means in the pattern above (Python also counts four separators)
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
# a run of blanks with the run of other characters after it: the pattern never joins a
# non-blank with a blank behind it, and no token holds such a pair either
_FRAGMENT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")


class CutEncoder:
    """Encodes texts by forced cuts; equal to the tokenizer on the whole text."""

    def __init__(self, name: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR):
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        #: cut[x][y]: bytes x, y stand next to each other in no token
        self.cut = (~inside).tolist()
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def pieces(self, fragment: str) -> list[str]:
        """Cut a fragment further, wherever its bytes force it and the split pattern does not look across.

        Not behind a blank (the pattern looks at what follows blanks) and not before an apostrophe
        (a piece that began with one could be taken for a contraction).
        """
        cut, out, start = self.cut, [], 0
        coded = fragment.encode("utf-8")
        for i, (x, y) in enumerate(zip(coded, coded[1:]), 1):
            # y begins a character
            if cut[x][y] and y & 0xC0 != 0x80 and y != 0x27:
                piece = coded[start:i].decode("utf-8")
                if piece[-1] not in _BLANK:
                    out.append(piece)
                    start = i
        out.append(coded[start:].decode("utf-8"))
        return out

    def fragment_ids(self, fragment: str) -> bytes:
        """Ids of a fragment as packed 32-bit integers."""
        parts, get = [], self.memo.get
        for piece in self.pieces(fragment):
            ids = get(piece)
            if ids is None:
                ids = np.asarray(self.bpe.encode_ordinary(piece), dtype=np.int32).tobytes()
                self._keep(piece, ids)
            parts.append(ids)
        out = b"".join(parts)
        self._keep(fragment, out)
        return out

    def _keep(self, text: str, ids: bytes) -> None:
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[text] = ids

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as packed 32-bit integers; none for a null or empty text."""
        if not text:
            return b""
        get, ids = self.memo.get, self.fragment_ids
        return b"".join([got if (got := get(f)) is not None else ids(f) for f in _FRAGMENT.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> CutEncoder:
    """The encoder of this process."""
    return CutEncoder(name, folder)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR, out_id: str = "doc_id") -> DataFrame:
    """``out_id``, ``ids`` of every row: the token ids of its whole text, without special tokens.

    Null and empty texts get an empty list; a blank text has the ids of its blanks. A narrow
    operator: no shuffle, one pass. Other columns of ``df`` are not read.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for ids, texts in _slices(batches, ROWS_OUT):
            packed = [enc.packed(t) for t in texts.to_pylist()]
            ends = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[out_id, "ids"])

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{out_id}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text_col: str, tokenizer: str = DEFAULT_TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id``, ``n_tokens`` of every row; 0 for null and empty texts."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for ids, texts in _slices(batches, 4096):
            n = np.fromiter((enc.count(t) for t in texts.to_pylist()), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n)], names=["id", "n_tokens"])

    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, n_tokens bigint")
