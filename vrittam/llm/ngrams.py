"""N-gram models: naive Bayes over languages, and the likelihood of an end of text."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np


class NgramBayes:
    """Multinomial naive Bayes on the character n-grams of words, lengths 1 to ``n``, add-half smoothing.

    Besides the labels it was shown it knows :data:`OTHER`, under which every n-gram is equally
    rare: a text whose n-grams are known under no label is of another language.
    """

    OTHER = "other"
    #: Words whose scores are kept.
    KEPT = 50_000

    def __init__(self, n: int = 3):
        self.n = n
        self.counts: dict[str, Counter] = defaultdict(Counter)
        self._rows: dict[str, int] | None = None

    def grams(self, word: str) -> list[str]:
        t = f" {word.lower()} "
        return [t[i : i + k] for k in range(1, self.n + 1) for i in range(len(t) - k + 1)]

    def add(self, label: str, words: Sequence[str]) -> None:
        for w in words:
            self.counts[label].update(self.grams(w))
        self._rows = None

    def _make(self) -> None:
        """Log probabilities of every known n-gram under every label."""
        self.labels = [*sorted(self.counts), self.OTHER]
        known = set().union(*self.counts.values()) if self.counts else set()
        size = len(known) + 1
        base = np.array([math.log(sum(self.counts[x].values()) + size / 2) for x in self.labels[:-1]])
        rare = -math.log(size)
        self._rows = {g: k for k, g in enumerate(sorted(known))}
        told = np.full((size, len(self.labels)), rare)  # the last row is that of unknown n-grams
        for j, x in enumerate(self.labels[:-1]):
            n = np.zeros(size)
            for g, k in self.counts[x].items():
                n[self._rows[g]] = k
            told[:, j] = np.log(n + 0.5) - base[j]
        self._told = told
        self._words: dict[str, np.ndarray] = {}

    def _score(self, word: str) -> np.ndarray:
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= self.KEPT:
                self._words.clear()
            row = self._rows.get
            got = self._words[word] = np.add.reduce(self._told[[row(g, -1) for g in self.grams(word)]])
        return got

    def _scores(self, words: Sequence[str]) -> np.ndarray:
        if self._rows is None:
            self._make()
        out = self._score(words[0])
        for w in words[1:]:
            out = out + self._score(w)
        return out

    def posterior(self, words: Sequence[str]) -> dict[str, float]:
        """Probability of each label, all labels equally likely beforehand; empty for no words."""
        if not words:
            return {}
        score = self._scores(words)
        odds = np.exp(np.maximum(score - score.max(), -700))
        return dict(zip(self.labels, (odds / odds.sum()).tolist()))

    def best(self, words: Sequence[str]) -> str:
        """Label of the largest posterior; nothing for no words."""
        if not words:
            return ""
        score = self._scores(words)
        return self.labels[int(score.argmax())]


class EndModel:
    """Whether a text may end behind given tokens, the nearest last: n-grams at ends of complete texts against n-grams at random cuts."""

    def __init__(self, n: int = 3, least: int = 4):
        self.n, self.least = n, least
        self.ends: Counter = Counter()
        self.cuts: Counter = Counter()

    def _contexts(self, tokens: Sequence[str]) -> list[tuple[str, ...]]:
        """The last tokens, most of them first."""
        t = tuple(tokens[-self.n :])
        return [t[-k:] for k in range(len(t), 0, -1)]

    def add(self, tokens: Sequence[str], complete: bool) -> None:
        if tokens:
            (self.ends if complete else self.cuts).update(self._contexts(tokens))
            (self.ends if complete else self.cuts)[()] += 1

    def log_odds(self, tokens: Sequence[str]) -> float:
        """Log likelihood of an end less that of a cut, by the longest n-gram seen often enough; negative where nothing is known."""
        ends, cuts = self.ends, self.cuts
        for c in self._contexts(tokens) if tokens else ():
            e, k = ends[c], cuts[c]
            if e + k >= self.least:
                return math.log((e + 0.25) / (k + 0.25)) + math.log((cuts[()] + 1) / (ends[()] + 1))
        return -1.0
