"""MinHash signatures over character n-grams (Broder 1997).

Hash values of all n-grams of a text come from one running sum: with an odd base B the polynomial hash of a
window is a difference of prefix sums times an inverse power of B, all modulo 2**64.  Each of the ``num_hashes``
orderings is an odd multiplier and an offset modulo 2**32, applied to well mixed 32-bit values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from gleaner.functions.slices import by_slices, list_array

# The base of the window hash and the multipliers of the 64-bit mixing step (MurmurHash3).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_BLOCK = 1024


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """One 64-bit hash per position of a character n-gram; a shorter, non-empty text is one n-gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    width = min(width, len(codes))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), BASE, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:-1])])
        count = len(codes) - width + 1
        undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count - 1, INVERSE, np.uint64)]))
        value = (sums[width:] - sums[:-width]) * undo
        value = value + np.uint64(width)
        for m in MIX:
            value ^= value >> np.uint64(33)
            value *= np.uint64(m)
        value ^= value >> np.uint64(33)
    return value


def shingle_values(text: str, width: int) -> np.ndarray:
    """The low 32 bits of the hashes."""
    return shingle_hashes(text, width).astype(np.uint32)


def orderings(num_hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    factor = rng.randint(0, 1 << 32, size=(num_hashes, 1), dtype=np.uint32) | np.uint32(1)
    offset = rng.randint(0, 1 << 32, size=(num_hashes, 1), dtype=np.uint32)
    return factor, offset


def signature(values: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    best = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
    buffer = np.empty((len(factor), min(_BLOCK, len(values))), dtype=np.uint32)
    for start in range(0, len(values), _BLOCK):
        block = values[start : start + _BLOCK]
        hashed = buffer[:, : len(block)]
        np.multiply(factor, block, out=hashed)
        np.add(hashed, offset, out=hashed)
        np.minimum(best, hashed.min(axis=1), out=best)
    return best


def minhash(text: Column, char_ngrams: int = 24, num_hashes: int = 260, seed: int = 42) -> Column:
    """Signature of ``num_hashes`` 32-bit values (as signed integers); null for a null or empty text."""
    factor, offset = orderings(num_hashes, seed)

    def signatures(texts: list[str | None]) -> pa.Array:
        return list_array([signature(shingle_values(t, char_ngrams), factor, offset).view(np.int32) if t else None for t in texts], pa.int32())

    return by_slices(signatures, "array<int>")(text)
