"""SuperMinHash signatures of character-gram sets, over whole Arrow batches at once.

Element ``e`` draws, from a generator seeded with its hash, values ``r_j + j`` for the places of a
random permutation, j = 0, 1, ...; a set's signature holds, for every place, the least value of
its elements. The correlated ranks give a lower variance than independent hash functions, and once
all places of a set lie under j, round j and later ones cannot change it.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-character grams inside the words of each text, and the text's number of each.

    Words are parted by single spaces. A text without a word of ``n`` characters has one element:
    itself; an empty text has none.
    """
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    line = cp == 10
    gap = np.concatenate(([0], np.cumsum(line | (cp == 32))))
    doc = np.cumsum(line) - line
    last = max(len(cp) - n + 1, 0)
    ok = np.flatnonzero(gap[n : n + last] == gap[:last])
    h = np.zeros(len(ok), dtype=_U)
    for k in range(n):
        h = mix(h ^ (cp[ok + k] + _U(k << 32)))
    of = doc[ok]
    bare = np.flatnonzero(np.bincount(of, minlength=len(texts))[: len(texts)] == 0)
    extra = [(int(i), _whole(texts[i])) for i in bare if texts[i]]
    if extra:
        of = np.concatenate((of, np.array([i for i, _ in extra], dtype=of.dtype)))
        h = np.concatenate((h, np.array([v for _, v in extra], dtype=_U)))
        order = np.argsort(of, kind="stable")
        of, h = of[order], h[order]
    return h, of


def _whole(text: str) -> int:
    h = np.zeros(1, dtype=_U)
    for c in text:
        h = mix(h ^ _U(ord(c) + (1 << 40)))
    return int(h[0])


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures, ``n_docs`` x ``m``; infinite for a text without elements."""
    uniq, inv = np.unique(h, return_inverse=True)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(uniq), 1))
    rows = np.arange(len(uniq))
    sig = np.full(n_docs * m, np.inf, dtype=np.float32)
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix(uniq ^ (_U(seed) * _U(0xD6E8FEB86659FD93)) ^ _U((j + 1) << 8))
        k = j + ((draw & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
        place = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[:, j]
        value = (draw >> _U(40)).astype(np.float32) / np.float32(1 << 24) + np.float32(j)
        np.minimum.at(sig, doc * m + place[inv], value[inv])
        # early stopping: texts whose places are all under j + 1 leave
        stay = (sig.reshape(n_docs, m).max(axis=1) > j + 1)[doc]
        if not stay.any():
            break
        if not stay.all():
            doc, keep = doc[stay], inv[stay]
            used, inv = np.unique(keep, return_inverse=True)
            uniq, perm = uniq[used], perm[used]
            rows = np.arange(len(uniq))
    return sig.reshape(n_docs, m)
