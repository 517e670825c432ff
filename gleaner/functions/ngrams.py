"""Word n-gram repetition scores for a batch of texts.

Top-n-gram share of ``n``: of the n-grams seen at least twice take the most frequent (ties: the longest);
its count times its length over the characters of the text.
Duplicate-n-gram share of ``n``: characters of all words that lie in a second or later occurrence of some
n-gram, each word counted once, over the characters of the text.

An n-gram can only repeat where its first n-1 words repeat, so each length starts from the repeats of the one before
and the work shrinks quickly.  All texts of a slice are handled in the same numpy calls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column

from gleaner.functions.slices import by_slices


def top_field(n: int) -> str:
    return f"top_{n}"


def dup_field(n: int) -> str:
    return f"dup_{n}"


def repetition_frame(texts: Sequence[str | None], top_ns: Sequence[int], dup_ns: Sequence[int]) -> pd.DataFrame:
    """Scores of a run of texts; an empty or null text has none."""
    n_docs = len(texts)
    pieces = [(t or "").split() for t in texts]
    counts = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=n_docs)
    chars = np.array([len(t) if t else 0 for t in texts], dtype=np.float64)
    chars[chars == 0] = np.nan
    flat = [w for p in pieces for w in p]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), counts)
    end = np.repeat(np.cumsum(counts), counts)
    length = np.fromiter((len(w) for w in flat), dtype=np.int64, count=len(flat))
    before = np.concatenate([[0], np.cumsum(length)])
    word = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    width = int(word.max()) + 1 if len(word) else 1

    top = {n: np.zeros(n_docs) for n in top_ns}
    dup = {n: np.zeros(n_docs) for n in dup_ns}
    at = np.arange(len(flat), dtype=np.int64)  # positions where the gram of the previous length repeats
    gram = doc.copy()  # its number; two texts never share one
    for n in range(1, max([*top_ns, *dup_ns], default=0) + 1):
        fits = at + n <= end[at]
        at, gram = at[fits], gram[fits]
        if not len(at):
            break
        gram = pd.factorize(gram * width + word[at + n - 1])[0].astype(np.int64)
        seen = np.bincount(gram)
        repeats = seen[gram] > 1
        at, gram = at[repeats], gram[repeats]
        if n in top:
            top[n] = _top(n, at, gram, seen, doc, before, n_docs)
        if n in dup:
            dup[n] = _covered(n, at, gram, len(seen), doc, length, n_docs)
    out = {top_field(n): top[n] / chars for n in top_ns}
    out |= {dup_field(n): dup[n] / chars for n in dup_ns}
    return pd.DataFrame(out)


def _firsts(gram: np.ndarray, size: int) -> np.ndarray:
    """Index of the first use of each gram number."""
    first = np.full(size, -1, dtype=np.int64)
    first[gram[::-1]] = np.arange(len(gram) - 1, -1, -1)
    return first


def _top(n, at, gram, seen, doc, before, n_docs) -> np.ndarray:
    best = np.zeros(n_docs)
    if len(at):
        first = _firsts(gram, len(seen))
        used = first[first >= 0]
        start = at[used]
        size = before[start + n] - before[start] + (n - 1)
        count = seen[gram[used]]
        order = np.lexsort((size, count, doc[start]))  # the last one of each text wins
        d = doc[start][order]
        last = np.append(d[1:] != d[:-1], True)
        best[d[last]] = (count * size)[order][last]
    return best


def _covered(n, at, gram, size, doc, length, n_docs) -> np.ndarray:
    first = _firsts(gram, size)
    later = at[first[gram] != np.arange(len(gram))]
    step = np.zeros(len(doc) + 1, dtype=np.int64)
    step[later] += 1  # positions are distinct
    np.subtract.at(step, later + n, 1)
    inside = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[inside], weights=length[inside], minlength=n_docs)


def repetition(text: Column, top_ns: Sequence[int], dup_ns: Sequence[int]) -> Column:
    """Struct column of all asked scores, ``top_2`` or ``dup_5`` and so on, from one pass over the text."""
    top_ns, dup_ns = sorted(set(top_ns)), sorted(set(dup_ns))
    fields = [top_field(n) for n in top_ns] + [dup_field(n) for n in dup_ns]

    def scores(texts: list[str | None]) -> pa.Array:
        frame = repetition_frame(texts, top_ns, dup_ns)
        return pa.StructArray.from_arrays([pa.array(frame[f], from_pandas=True) for f in fields], fields)

    return by_slices(scores, ", ".join(f"{f} double" for f in fields))(text)
