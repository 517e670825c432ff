"""Tokenizers as column functions from string to array of int."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]
Encoder = Callable[[Sequence[str]], Sequence[Sequence[int]]]

# A run of letters, marks, digits and underscores, or any other single visible character.
PIECE = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"
VOCABULARY = 65_536


def hashed_tokens(vocabulary: int = VOCABULARY) -> Tokenizer:
    """The default: pieces numbered by hash.  It needs no model file and runs inside the engine."""

    def tokenize(text: Column) -> Column:
        number = lambda piece: F.conv(F.substring(F.md5(piece), 1, 8), 16, 10).cast("bigint") % vocabulary
        return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: number(p).cast("int"))

    return tokenize


def encoder_tokens(load: Callable[[], Encoder]) -> Tokenizer:
    """Any tokenizer library.  ``load`` runs once per Python worker and gives a function over a batch of texts."""
    held: list[Encoder] = []

    def tokenize(text: Column) -> Column:
        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            if not held:
                held.append(load())
            present = texts[texts.notna()]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            out[present.index] = pd.Series(list(map(list, held[0](present.tolist()))), index=present.index, dtype=object)
            return out

        return encode.asNondeterministic()(text)

    return tokenize


def file_tokens(path: str) -> Tokenizer:
    """A tokenizer saved as JSON by the ``tokenizers`` package, without special tokens."""

    def load() -> Encoder:
        from tokenizers import Tokenizer as Saved

        saved = Saved.from_file(path)
        return lambda texts: [e.ids for e in saved.encode_batch(list(texts), add_special_tokens=False)]

    return encoder_tokens(load)
