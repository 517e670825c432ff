"""Naive Bayes over hashed character n-grams, for batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from gleaner.functions.minhash import BASE

_RUN_CHARS = 250_000
PSEUDO = 20


def grams(texts: Sequence[str | None], ns: Sequence[int], features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length, the text number, ascending, and the feature number of every character n-gram, case ignored."""
    joined = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(joined), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(joined)), [len(j) // 4 for j in joined])
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ns) + 1):
        count = max(len(codes) - n + 1, 0)
        value = (value[:count] + codes[n - 1 :] + np.uint64(1)) * np.uint64(BASE)
        if n in ns:
            whole = doc[:count] == doc[n - 1 :]
            yield doc[:count][whole], ((value[whole] >> np.uint64(32)) % np.uint64(features)).astype(np.int64)


def runs(texts: Sequence[str | None]) -> Iterator[Sequence[str | None]]:
    """Consecutive texts of about _RUN_CHARS characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= _RUN_CHARS or i == len(texts):
            yield texts[start:i]
            start, size = i, 0


@dataclass
class CharacterModel:
    """Naive Bayes: log probability of each feature under each label, and of the labels.

    The likeliest label is the one with the highest probability of the whole text.  Its score is its share of the
    geometric means of the n-grams' probabilities, ``PSEUDO`` n-grams that speak for no label added, times the share of the
    text's n-grams that the label has shown in training.  So it does not run to 1 with the length of a text: a text of a few
    characters has a low score, and one in an unknown script a score near 0.
    """

    labels: Sequence[str]
    prior: np.ndarray
    features: np.ndarray
    ns: Sequence[int]

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each label, and the share of n-grams that it has shown; one row per text."""
        sums = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        counts, shown = np.zeros(len(texts)), np.zeros((len(texts), len(self.labels)))
        known = self.features > self.features.min(axis=0) + 1e-6
        for doc, gram in grams(texts, self.ns, len(self.features)):
            if len(doc):
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                sums[doc[starts]] += np.add.reduceat(self.features[gram], starts, axis=0, dtype=np.float64)
                shown[doc[starts]] += np.add.reduceat(known[gram], starts, axis=0, dtype=np.float64)
                counts += np.bincount(doc, minlength=len(texts))
        means = sums / (counts + PSEUDO)[:, None]
        odds = np.exp(means - means.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True), shown / np.maximum(counts, 1)[:, None]

    def best(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score and name of the likeliest label of each text."""
        parts = [self.scores(run) for run in runs(texts)]
        if not parts:
            return np.zeros(0), np.zeros(0, dtype=object)
        share, shown = (np.concatenate(x) for x in zip(*parts))
        best = share.argmax(axis=1)
        row = np.arange(len(best))
        return share[row, best] * shown[row, best], np.array(self.labels, dtype=object)[best]
