"""Functions of texts in Python, fed in slices of bounded bytes.

The engine hands a worker 10,000 rows at once unless the session says otherwise, and what a function makes of them, strings,
words, n-gram hashes, is many times their size.  Here it sees about ``SLICE_BYTES`` of text at a time and its results leave before
the next slice, so a worker's memory follows neither the batch nor the table.  A longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_ROW = 64  # what a row counts beside its bytes, so that empty ones end a slice as well


def spans(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together, at least one row each."""
    ends = np.cumsum(sizes.astype(np.int64) + _ROW)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return (texts.slice(start, stop - start) for start, stop in spans(sizes, limit))


def by_slices(function: Callable[[list[str | None]], pa.Array], returns: str) -> Callable[[Column], Column]:
    """A column function out of ``function``, which gives a value per text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_slices(batch):
                yield function(texts.to_pylist())

    # Marked so that a filter on the result does not make the optimizer run the function twice.
    return F.arrow_udf(run, returns).asNondeterministic()


def list_array(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays of numbers as one list column; none is null."""
    offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
    held = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(held) if held else [], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([r is None for r in rows], pa.bool_()))
