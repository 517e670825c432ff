"""Words and word windows of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

Both word classes of this subpackage exclude ASCII characters only, so words can be cut from the bytes: no byte of a
longer UTF-8 sequence is ASCII.  A word's hash is a polynomial over its bytes modulo 2^64 with a random value per byte,
mixed; the hash of a window is a polynomial over its words' hashes.  Both come from running sums, whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are worked on in blocks of about so many bytes, cut between words
BATCH_BYTES = 8 << 20  # an Arrow batch is taken in runs of whole texts of about so many bytes

_BYTES = np.arange(256)
#: ``[\x20\x09-\x0D]``
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``
NON_ALNUM = (_BYTES < 0x30) | ((_BYTES > 0x39) & (_BYTES < 0x61)) | ((_BYTES > 0x7A) & (_BYTES < 0x80))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

_random = np.random.default_rng(20240229)
_BYTE_VALUES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_BASE, WORD_BASE, SECOND_BASE = (int(x) | 1 for x in _random.integers(1 << 62, 1 << 63, 3))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of MurmurHash3 (public domain): every input bit reaches every output bit."""
    x = (x ^ (x >> _33)) * _M1
    x = (x ^ (x >> _33)) * _M2
    return x ^ (x >> _33)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` (odd) to 0..n-1 modulo 2^64, and the inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(BLOCK_BYTES + 1024, n)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class Words(NamedTuple):
    """Words in text order: place of their bytes in ``data``, number of their text, hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    def first(self, n_texts: int) -> np.ndarray:
        """The index of each text's first word, and the number of words last."""
        return np.searchsorted(self.text, np.arange(n_texts + 1))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the ``n + 1`` bounds of its texts; a null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(bounds[-1]) if len(bounds) else 0
    data = np.frombuffer(column.buffers()[2], np.uint8)[:size] if size else np.zeros(0, np.uint8)
    first = int(bounds[0]) if len(bounds) else 0
    return data[first:], (bounds - first if len(bounds) else np.zeros(1, np.int64))


def parts(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes."""
    if batch.num_rows == 0:
        return
    _, bounds = texts_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def cut_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """The words of the texts ``data[bounds[i]:bounds[i + 1]]``, bytes first mapped by ``fold``."""
    data = fold[data] if fold is not SAME else data
    size = len(data)
    inside = ~separators[data]
    edges = bounds[(bounds > 0) & (bounds < size)]
    starting = inside.copy()
    starting[1:] &= ~inside[:-1]
    starting[edges] = inside[edges]
    ending = inside.copy()
    ending[:-1] &= ~inside[1:]
    ending[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
    del starting, ending, inside
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(int(np.searchsorted(ends, low + BLOCK_BYTES, "right")), at + 1)
        block = data[low : ends[to - 1]]
        power, inverse = powers(_BYTE_BASE, len(block))
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[block] * power, out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    text = np.searchsorted(bounds, starts, "right") - 1
    return Words(data, starts, ends, text, hashes)


def windows(words: Words, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each run of ``size`` words of one text."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.text[: n - size + 1] == words.text[size - 1 :])
    power, inverse = powers(base, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * power, out=total[1:])
    return at, mix((total[at + size] - total[at]) * inverse[at] + np.uint64(size))
