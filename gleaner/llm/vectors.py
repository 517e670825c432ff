"""Vectors of a list column as integer matrices, for numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integer_vectors(column: pa.Array, dims: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dims`` finite numbers, and ``floor(scale * x)`` of those rows' numbers.

    A null, a null or non-finite entry and any other length make a row unfit.  Integers of ``limit`` or more either way
    are an error, as sums of their products would no longer be exact.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fit = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims
    flat = column.filter(pa.array(fit)).flatten().cast(pa.float64())
    matrix = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null entry becomes nan
    finite = np.isfinite(matrix).all(axis=1)
    fit[fit] = finite
    scaled = np.floor(matrix[finite] * scale)
    if scaled.size and np.abs(scaled).max() >= limit:
        raise ValueError(f"a component times {scale} is {limit} or more")
    return fit, scaled.astype(np.int64)
