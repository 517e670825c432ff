"""Hashed word and character n-gram features and a logistic regression over them, in numpy.

A feature's value is its count in the text over the number of words, times ``SCALE``.  As that is a sum over words, a
distinct word is worked out once per batch, however often it stands there.  The model is a vector of ``2^bits`` weights.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import NON_ALNUM, LOWER, SAME, SPACE, Words, cut_words, mix, parts, texts_of

SCALE = 20.0


class Features(NamedTuple):
    """What the words are and which n-grams count: of ``chars`` characters anywhere in a word or, with ``prefixes``,
    at its start; and runs of ``words`` words."""

    letters_only: bool
    chars: tuple[int, ...]
    prefixes: bool
    words: tuple[int, ...]
    bits: int

    def cut(self, column: pa.Array) -> Words:
        return cut_words(*texts_of(column), NON_ALNUM if self.letters_only else SPACE, LOWER if self.letters_only else SAME)

    def slots(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        return (mix(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_words(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``which``, slot) of the character n-grams of the chosen words; a word's ends are characters too."""
        starts, ends = words.starts[which], words.ends[which]
        sizes = ends - starts
        total = int(sizes.sum())
        # The chosen words' bytes one after the other, each between two marks.
        bounds = np.cumsum(np.r_[0, sizes + 2])
        data = np.zeros(total + 2 * len(which), np.uint8)
        inner = np.arange(total) + 2 * np.repeat(np.arange(len(which)), sizes) + 1
        data[inner] = words.data[np.repeat(starts - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(total)] if total else 0
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters, marks included
        word_of = np.searchsorted(bounds, begins, "right") - 1
        last = np.searchsorted(begins, bounds)  # index of each word's first character
        owners, slots = [], []
        value = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
        code = value[data]
        # A character's code: its up to four bytes folded together.
        edge = np.r_[begins[1:], len(data)]
        char = np.zeros(len(begins), np.uint64)
        for i in range(4):
            at = begins + i
            on = at < edge
            char[on] = mix(char[on] * np.uint64(31) + code[at[on]])
        for n in self.chars:
            at = last[:-1] if self.prefixes else np.arange(max(0, len(begins) - n + 1))
            at = at[at + n <= len(begins)]
            at = at[at + n <= last[word_of[at] + 1]]
            gram = np.zeros(len(at), np.uint64)
            for i in range(n):
                gram = mix(gram * np.uint64(0x100000001B3) + char[at + i])
            owners.append(word_of[at])
            slots.append(self.slots(gram, 100 + n))
        return np.concatenate(owners) if owners else np.zeros(0, np.int64), np.concatenate(slots) if slots else np.zeros(0, np.int64)

    def runs(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, slot) of the runs of ``size`` words."""
        n = len(words.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
        run = words.hashes[at]
        for i in range(1, size):
            run = mix(run * np.uint64(31) + words.hashes[at + i])
        return words.text[at], self.slots(run, size)

    def sparse(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, slot, value), sorted, of all features of the texts."""
        words = self.cut(column)
        distinct, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        owner, slot = self.of_words(words, where)
        order = np.argsort(owner, kind="stable")
        slot = slot[order]
        bounds = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
        count = np.diff(bounds)[back]
        texts = np.repeat(words.text, count)
        ahead = np.cumsum(count) - count
        slots = slot[np.repeat(bounds[:-1][back] - ahead, count) + np.arange(int(count.sum()))] if len(slot) else slot
        texts, slots = [texts], [slots]
        for size in self.words:
            t, s = self.runs(words, size)
            texts.append(t)
            slots.append(s)
        name, times = np.unique((np.concatenate(texts) << self.bits) | np.concatenate(slots), return_counts=True)
        text = name >> self.bits
        n_words = np.maximum(1, np.diff(words.first(len(column))))
        return text, name & ((1 << self.bits) - 1), times * (SCALE / n_words[text])

    def scores(self, column: pa.Array, weights: np.ndarray) -> np.ndarray:
        """The sum of weight times value per text."""
        words = self.cut(column)
        n = len(column)
        distinct, where, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        owner, slot = self.of_words(words, where)
        of_word = np.bincount(owner, weights=weights[slot], minlength=len(distinct))
        total = np.bincount(words.text, weights=of_word[back] if len(back) else None, minlength=n)
        for size in self.words:
            text, slot = self.runs(words, size)
            total += np.bincount(text, weights=weights[slot], minlength=n)
        return total * SCALE / np.maximum(1, np.diff(words.first(n)))


class Rows(NamedTuple):
    """Sparse rows: bounds, slots and values.  Sums go over blocks of rows, so that they need little memory of their own."""

    bounds: np.ndarray
    slots: np.ndarray
    values: np.ndarray

    def blocks(self, size: int = 1 << 20):
        i, n = 0, len(self.bounds) - 1
        while i < n:
            j = max(int(np.searchsorted(self.bounds, self.bounds[i] + size, "right")) - 1, i + 1)
            yield i, min(j, n)
            i = j

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.bounds) - 1)
        for i, j in self.blocks():
            a, b = self.bounds[i], self.bounds[j]
            total = np.r_[0.0, np.cumsum(self.values[a:b] * w[self.slots[a:b]])]
            out[i:j] = total[self.bounds[i + 1 : j + 1] - a] - total[self.bounds[i:j] - a]
        return out

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i, j in self.blocks():
            a, b = self.bounds[i], self.bounds[j]
            out += np.bincount(self.slots[a:b], weights=self.values[a:b] * np.repeat(r[i:j], np.diff(self.bounds[i : j + 1])), minlength=size)
        return out

    def take(self, which: np.ndarray) -> Rows:
        count = np.diff(self.bounds)[which]
        ahead = np.cumsum(count) - count
        at = np.repeat(self.bounds[:-1][which] - ahead, count) + np.arange(int(count.sum()))
        return Rows(np.r_[0, np.cumsum(count)], self.slots[at], self.values[at])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def minimise(f, w: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking step; ``f`` gives value and gradient."""
    value, grad = f(w)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q = -grad
        stack = []
        for s, y, rho in reversed(history):
            a = rho * (s @ q)
            q = q - a * y
            stack.append(a)
        if history:
            s, y, rho = history[-1]
            q = q / (rho * (y @ y))
        for (s, y, rho), a in zip(history, reversed(stack)):
            q = q + (a - rho * (y @ q)) * s
        slope, step = grad @ q, 1.0 if history else 1.0 / max(1e-12, float(np.abs(grad).sum()))
        while True:
            new_value, new_grad = f(w + step * q)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * q, new_grad - grad
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, grad = w + s, new_value, new_grad
        if s @ y > 1e-12:
            history = [*history, (s, y, 1 / (s @ y))][-memory:]
        if done:
            break
    return w


def fit(rows: Rows, label: np.ndarray, used: np.ndarray, size: int, l2: float, penalty: float = 0.0, rounds: int = 80) -> np.ndarray:
    """Weights and, last, the bias: mean logistic loss of the ``used`` rows plus ``l2`` times the squares of the weights plus
    ``penalty`` times the mean square of the scores of the rows of label -1, differences whose scores shall be zero."""
    apart = label < 0
    n, m = max(1, int(used.sum())), max(1, int(apart.sum()))
    target = np.where(used, label, 0.0)

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        d = rows.times(w)
        z = d + w[-1]
        loss = float((np.logaddexp(0, z[used]) - z[used] * target[used]).sum()) / n + l2 * float(w[:-1] @ w[:-1])
        r = np.where(used, sigmoid(z) - target, 0.0) / n
        bias = r.sum()
        if penalty:
            loss += penalty * float(d[apart] @ d[apart]) / m
            r[apart] = 2 * penalty * d[apart] / m
        grad = rows.back(r, size + 1)
        grad[-1] = bias
        grad[:-1] += 2 * l2 * w[:-1]
        return loss, grad

    return minimise(f, np.zeros(size + 1), rounds)


def calibrate(scores: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log odds (Platt 1999, with his targets that keep off 0 and 1)."""
    n1, n0 = float(label.sum()), float(len(label) - label.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * scores + p[1]
        r = sigmoid(z) - target
        return float(np.logaddexp(0, z).sum() - z @ target), np.array([r @ scores, r.sum()])

    a, b = minimise(f, np.array([1.0, 0.0]), 100)
    return float(a), float(b)



def sparse_rows(texts: list[str], features: Features) -> Rows:
    text, slot, value = features.sparse(pa.array(texts, pa.large_string()))
    return Rows(np.searchsorted(text, np.arange(len(texts) + 1)), slot, value)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled documents, those with the smallest hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows of two numbers


def features_task(features: Features, variants=()):
    """For ``mapInArrow`` over (doc_id, text, label): sparse features, and rows of label -1 with the difference between a
    text's features and those of each of its variants."""
    schema = pa.schema([("row", pa.int64()), ("label", pa.int32()), ("fold", pa.int32()), ("slots", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    def lists(rows: Rows) -> list[pa.Array]:
        offsets = pa.array(rows.bounds.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (rows.slots.astype(np.int32), rows.values.astype(np.float32))]

    def run(batches):
        for batch in batches:
            for part in parts(batch, limit=1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                docs = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64)
                fold = (mix(docs + np.uint64(5)) % np.uint64(5)).astype(np.int32)
                own = sparse_rows(texts, features)
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(fold), *lists(own)], schema=schema)
                for variant in variants:
                    other = [variant(t) for t in texts]
                    new = np.flatnonzero([a != b for a, b in zip(texts, other)])
                    if len(new):
                        apart = differences(own.take(new), sparse_rows([other[i] for i in new], features), features.bits)
                        mark = pa.array(np.full(len(new), -1, np.int32))
                        yield pa.record_batch([part.column("doc_id").take(pa.array(new)), mark, pa.array(fold[new]), *lists(apart)], schema=schema)

    return run


FEATURES = "row long, label int, fold int, slots array<int>, values array<float>"


def differences(a: Rows, b: Rows, bits: int) -> Rows:
    """Row by row ``a - b``, without what is equal."""
    n = len(a.bounds) - 1
    text = np.r_[np.repeat(np.arange(n), np.diff(a.bounds)), np.repeat(np.arange(n), np.diff(b.bounds))]
    name, back = np.unique((text << bits) | np.r_[a.slots, b.slots], return_inverse=True)
    value = np.bincount(back, weights=np.r_[a.values, -b.values], minlength=len(name))
    on = np.abs(value) > 1e-9
    return Rows(np.searchsorted(name[on] >> bits, np.arange(n + 1)), name[on] & ((1 << bits) - 1), value[on])


def collect_rows(sample: DataFrame, features: Features, variants=()) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, labels (-1: differences to a variant) and folds of a bounded sample, in order of the id."""
    found = sample.mapInArrow(features_task(features, variants), FEATURES).orderBy("row", F.desc("label")).toArrow()
    label = found.column("label").to_numpy().astype(np.float64)
    fold = found.column("fold").to_numpy()
    sizes = [np.diff(c.offsets.to_numpy()) for c in found.column("slots").chunks]
    bounds = np.r_[0, np.cumsum(np.concatenate(sizes, dtype=np.int64))] if sizes else np.zeros(1, np.int64)
    slots, values = (np.concatenate([c.flatten().to_numpy() for c in found.column(x).chunks] or [np.zeros(0, t)]) for x, t in (("slots", np.int32), ("values", np.float32)))
    return Rows(bounds, slots, values), label, fold


class Model(NamedTuple):
    """A fitted classifier; ``score`` gives the probability of label 1."""

    features: Features
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.features.scores(column, self.weights[:-1]) + self.weights[-1]
        return sigmoid(self.slope * z + self.offset)


def train(sample: DataFrame, features: Features, l2: float, variants=(), penalty: float = 0.0) -> Model:
    """Fit on four fifths of the sample, calibrate on the fifth.  Without rows, or with one label only, the score is the label's share."""
    rows, label, fold = collect_rows(sample, features, variants)
    size, own = 1 << features.bits, label >= 0
    if not own.any() or label[own].min() == label.max():
        share = float(label[own].mean()) if own.any() else 0.0
        return Model(features, np.zeros(size + 1, np.float32), 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    used, held = own & (fold > 0), own & (fold == 0)
    if not used.any() or not held.any():
        used = held = own
    weights = fit(rows, label, used, size, l2, penalty)
    slope, offset = calibrate(rows.times(weights)[held] + weights[-1], label[held])
    return Model(features, weights.astype(np.float32), max(slope, 1e-3), offset)
