"""Phrases of a word list found in texts: longest match on a trie over token hashes.

A token is a run of letters, marks, digits and underscores.  A phrase is named by rolling hashes over its tokens, each
with what stands before it in the phrase, so all its beginnings have a name too.  The trie is the sorted array of these names
with the kinds of phrase that end there: 9 bytes a name, in which a million phrases take some 20 MB.  A text's tokens are hashed
at once; only those that begin a phrase are followed further.  Time goes with the text, not with the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

# Letters, digits and underscore, and the combining marks of Latin and Devanagari, which are no letters to Python.
TOKEN = re.compile(r"[\w\u0300-\u036f\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0951-\u0957\u0962\u0963]+")
MAX_NAMES = 20_000_000
_FACTOR, _33 = np.uint64(0x9E3779B97F4A7C15), np.uint64(33)


def hashes(tokens: Sequence[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object)) if len(tokens) else np.zeros(0, np.uint64)


def step(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Name of a phrase's beginning by that of the one before and the hash of the next token."""
    x = (before ^ (before >> _33)) * _FACTOR + token
    return (x ^ (x >> _33)) * _FACTOR


def units(phrase: str) -> list[str]:
    """The tokens of a phrase, each but the first with what stands between it and the one before."""
    spans = [m.span() for m in TOKEN.finditer(phrase)]
    return [phrase[(spans[i - 1][1] if i else begin) : end] for i, (begin, end) in enumerate(spans)]


def names(phrase: str) -> list[int]:
    """Names of the phrase's beginnings, the whole last; none where it holds no token."""
    out, name = [], np.zeros(1, np.uint64)
    for h in hashes(units(phrase)):
        name = step(name, np.array([h], np.uint64))
        out.append(int(name[0]))
    return out


class Gazetteer:
    """Trie of phrases; ``kinds`` holds a bit per kind of phrase that ends at the name, 0 where none does."""

    def __init__(self, name: np.ndarray, kinds: np.ndarray, labels: Sequence[str]):
        order = np.argsort(name, kind="stable")
        self.name, self.kinds, self.labels = name[order], kinds[order].astype(np.uint8), list(labels)

    @classmethod
    def of(cls, phrases: Mapping[str, Sequence[str]]) -> Gazetteer:
        """From a list per kind."""
        bits: dict[int, int] = {}
        for bit, listed in enumerate(phrases.values()):
            for phrase in listed:
                for name in (found := names(phrase)):
                    bits[name] = bits.get(name, 0) | (1 << bit if name == found[-1] else 0)
        return cls(np.array(list(bits), np.uint64), np.array(list(bits.values()), np.uint8), list(phrases))

    @classmethod
    def from_table(cls, df: DataFrame, phrase: str, kind: str, labels: Sequence[str], max_names: int = MAX_NAMES) -> Gazetteer:
        """From a table of phrases and their kinds, hashed by tasks.

        The names are counted before they are brought together; more than ``max_names`` are an error.  Null phrases and other
        kinds are left out, a repeated phrase counts once.
        """
        if not 0 < len(labels) <= 8:
            raise ValueError("between 1 and 8 kinds")
        bit = F.element_at(F.create_map(*[x for i, label in enumerate(labels) for x in (F.lit(label), F.lit(1 << i))]), F.col(kind))
        listed = df.filter(F.col(kind).isin(list(labels)) & F.col(phrase).isNotNull()).select(F.col(phrase).alias("phrase"), bit.alias("bit"))

        def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(n, b if i == len(found) - 1 else 0) for p, b in zip(batch["phrase"], batch["bit"]) for found in [names(p)] for i, n in enumerate(found)]
                yield pd.DataFrame({"name": np.array([n for n, _ in rows], np.uint64).view(np.int64), "kinds": np.array([k for _, k in rows], np.int32)})

        table = listed.mapInPandas(named, "name long, kinds int").groupBy("name").agg(F.bit_or("kinds").alias("kinds"))
        table = materialize(table, "gazetteer")
        if (count := table.count()) > max_names:
            raise ValueError(f"{count} names of phrases, more than {max_names}")
        rows = table.toPandas()
        return cls(rows["name"].to_numpy(np.int64).view(np.uint64), rows["kinds"].to_numpy(np.uint8), labels)

    def _kinds(self, wanted: np.ndarray) -> np.ndarray:
        """Bits of each name; -1 where it is none of the trie."""
        if not len(self.name):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.name, wanted), len(self.name) - 1)
        return np.where(self.name[at] == wanted, self.kinds[at].astype(np.int64), -1)

    def find(self, texts: Sequence[str]) -> list[list[tuple[str, int, int, int]]]:
        """Per text, kind, begin, end and number of the last token of the longest phrase of each kind at every token."""
        tokens = [TOKEN.findall(t) for t in texts]
        first = np.cumsum([0, *map(len, tokens)])
        name = step(np.zeros(first[-1], np.uint64), hashes([w for ws in tokens for w in ws]))
        known = self._kinds(name)
        start = np.flatnonzero(known >= 0)
        out: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
        if not len(start):
            return out
        text = np.searchsorted(first, start, "right") - 1
        spans = {int(t): [m.span() for m in TOKEN.finditer(texts[t])] for t in np.unique(text)}
        longest: dict[tuple[int, int, int], int] = {}  # text, token, kind: last token
        at, last, name, known = start - first[text], start - first[text], name[start], known[start]
        while len(at):
            for t, a, z, k in zip(text[known > 0].tolist(), at[known > 0].tolist(), last[known > 0].tolist(), known[known > 0].tolist()):
                for bit in range(len(self.labels)):
                    if k >> bit & 1:
                        longest[t, a, bit] = z
            on = np.array([z + 1 < len(spans[t]) for t, z in zip(text.tolist(), last.tolist())], bool)
            text, at, last, name = text[on], at[on], last[on] + 1, name[on]
            following = [texts[t][spans[t][z - 1][1] : spans[t][z][1]] for t, z in zip(text.tolist(), last.tolist())]
            name = step(name, hashes(following))
            known = self._kinds(name)
            on = known >= 0
            text, at, last, name, known = text[on], at[on], last[on], name[on], known[on]
        for (t, a, bit), z in sorted(longest.items()):
            out[t].append((self.labels[bit], spans[t][a][0], spans[t][z][1], z))
        return out
