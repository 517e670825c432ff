"""Embedding whitening by bit-sliced scatter, exact up to the eigenvectors.

Vectors become integers ``floor(scale * x)``; each distinct one counts once.  In a task the integers of a chunk are shifted
to be 0 or more, and every bit of every dimension becomes a plane: that bit of all the chunk's rows, packed into 64-bit
words.  The sum of products of two dimensions is then the popcount of the AND of their planes, weighted by the powers of
two that the planes stand for.  The shift is undone in integers, tasks return sums of one size whatever they read, and the
scatter is centred as integers, ``n * sum(xy) - sum(x) * sum(y)``, before it is divided and its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.vectors import integer_vectors

CHUNK = 16384  # rows whose planes are held at a time
LIMIT = 1 << 40  # of an integer: sums of products of 2^40 rows then fit in 38 digits
_SHORT = np.iinfo(np.int16)


def pack_rows(x: np.ndarray) -> pa.Array:
    """Each row as bytes: 16 bits a number where all of the row fit, else 64, so that equal rows have equal bytes."""
    narrow = ((x >= _SHORT.min) & (x <= _SHORT.max)).all(axis=1)
    out = []
    for rows, kind in ((x[narrow], np.int16), (x[~narrow], np.int64)):
        data = np.ascontiguousarray(rows.astype(kind))
        width = data.itemsize * x.shape[1]
        offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
        out.append(pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary()))
    return pa.concat_arrays(out)


def unpack_rows(column: pa.Array, dims: int) -> np.ndarray:
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    if (lengths == 2 * dims).all() and len(column):
        start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        return np.frombuffer(column.buffers()[2], np.int16, len(column) * dims, start).reshape(-1, dims).astype(np.int64)
    rows = [np.frombuffer(v.as_buffer(), np.int16 if n == 2 * dims else np.int64) for v, n in zip(column, lengths)]
    return np.array(rows, np.int64).reshape(len(rows), dims)


def planes_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of numbers 0 and above: the words, one row per plane, and each plane's dimension and bit."""
    words, dimension, bit = [], [], []
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    padded[: len(y)] = y
    for a in range(int(y.max()).bit_length() if y.size else 0):
        packed = np.packbits(((padded >> np.uint64(a)) & np.uint64(1)).astype(np.uint8), axis=0)
        plane = np.ascontiguousarray(packed.T).view(np.uint64)
        used = np.flatnonzero(plane.any(axis=1))
        words.append(plane[used])
        dimension.append(used)
        bit.append(np.full(len(used), a))
    if not words:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(dimension), np.concatenate(bit)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns of ``x``, as Python's integers."""
    n, dims = x.shape
    shift = x.min(axis=0)
    words, dimension, bit = planes_of((x - shift).astype(np.uint64))
    both = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        both[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    weights = np.zeros((dims, len(words)), dtype=object)
    weights[dimension, np.arange(len(words))] = [1 << int(a) for a in bit]
    if len(bit) == 0 or 2 * int(bit.max()) + 2 + n.bit_length() < 63:  # no sum leaves 64 bits
        weights = weights.astype(np.int64)
    sums = weights @ np.diagonal(both)
    products = (weights @ both @ weights.T).astype(object)
    sums, shift = sums.astype(object), shift.astype(object)
    moved = products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return sums + n * shift, moved


def vectors_task(dims: int, scale: int):
    """For ``mapInArrow``: the packed integers of every whole vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integer_vectors(batch.column(0), dims, scale, LIMIT)
            yield pa.record_batch([pack_rows(x)], ["x"])

    return run


def scatter_task(dims: int, chunk: int):
    """For ``mapInArrow``: number, sums and sums of products of the packed vectors.

    ``(-1, -1)`` is the number, ``(-1, j)`` the sum of dimension j, ``(i, j)`` the sum of products, i up to j.
    """
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        held: list[np.ndarray] = []

        def take(x: np.ndarray) -> None:
            nonlocal n, sums, products
            s, p = cross_products(x)
            n, sums, products = n + len(x), sums + s, products + p

        for batch in batches:
            held.append(unpack_rows(batch.column(0), dims))
            while sum(map(len, held)) >= chunk:
                rows = np.concatenate(held)
                take(rows[:chunk])
                held = [rows[chunk:]]
        if sum(map(len, held)):
            take(np.concatenate(held))
        i, j = np.triu_indices(dims)
        at = np.r_[[-1] * (dims + 1), i], np.r_[-1, np.arange(dims), j]
        values = [Decimal(int(v)) for v in (n, *sums, *products[i, j])]
        yield pa.record_batch([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(values, kind)], ["i", "j", "total"])

    return run


@dataclass
class Whitening:
    """Of ``n`` distinct vectors: sums per dimension, and the leading components as columns with their eigenvalues.

    ``explained`` is each eigenvalue's share of the trace; ``identity_error`` the largest entry, sign aside, of the
    covariance of the whitened vectors less the identity.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        """Columns that whiten a centred vector; nan for a component without variance."""
        scale = np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))
        return self.components / scale


def solve(n: int, sums: list[int], products: np.ndarray, components: int) -> Whitening:
    """Components of the exact scatter.  Eigenvalues within rounding of 0 are 0."""
    dims = len(sums)
    centred = [[n * int(products[i, j]) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])  # correctly rounded quotients of integers
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components]
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    values[values <= trace * dims * np.finfo(float).eps] = 0.0
    made = Whitening(n, sums, vectors, values, values / trace if trace else np.zeros(len(values)), 0.0)
    whole = np.flatnonzero(values > 0)
    w = made.projection[:, whole]
    made.identity_error = float(np.abs(w.T @ covariance @ w - np.eye(len(whole))).max()) if len(whole) else 0.0
    return made


def fit_whitening(vectors: DataFrame, components: int, dims: int, scale: int, chunk: int = CHUNK) -> Whitening | None:
    """Fit on each distinct integer vector of the column ``vector`` once; None without any."""
    packed = vectors.select("vector").mapInArrow(vectors_task(dims, scale), "x binary").distinct()
    parts = packed.mapInArrow(scatter_task(dims, chunk), "i int, j int, total decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()  # dims squared over two, and dims
    totals = {(r["i"], r["j"]): int(r["total"]) for r in rows}
    n = totals.get((-1, -1), 0)
    if not n:
        return None
    products = np.zeros((dims, dims), dtype=object)
    for i in range(dims):
        for j in range(i, dims):
            products[i, j] = products[j, i] = totals[i, j]
    return solve(n, [totals[-1, d] for d in range(dims)], products, components)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - sums`` as doubles, and the exact sum of its squares per row."""
    reach = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums))
    exact = np.int64 if reach * reach * x.shape[1] < 1 << 63 else object
    off = x.astype(exact) * n - np.array(sums, dtype=exact)
    return off.astype(np.float64), (off * off).sum(axis=1)


def whiten_task(shared, dims: int, scale: int):
    """For ``mapInArrow``: a row per whole vector and component."""
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        k = len(fitted.eigenvalues)
        for batch in batches:
            fit, x = integer_vectors(batch.column(1), dims, scale, LIMIT)
            off, total = deviations(x, fitted.n, fitted.sums)
            values = (off / fitted.n) @ fitted.projection
            deviation = pa.array(total, pa.int64()).cast(schema.field(2).type) if total.dtype != object else pa.array([Decimal(int(t)) for t in total], schema.field(2).type)
            times = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [
                    batch.column(0).filter(pa.array(fit)).take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    deviation.take(pa.array(times)),
                    pa.array(values.reshape(-1), mask=np.isnan(values).reshape(-1)),
                ],
                schema=schema,
            )

    return run


def whiten(df: DataFrame, components: int = 4, dims: int = 64, scale: int = 256, id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and leading component.

    Left out are rows whose vector is null, has not ``dims`` components, or holds a null or non-finite one.  ``n`` is the
    number of distinct integer vectors, on which the fit rests; repeated rows and rows without an id get rows as any
    other.  ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, exact (decimal).  ``whitened`` is the centred vector
    along the component over the root of its eigenvalue, null for a component without variance, as when all vectors are
    equal.  No vectors give no rows.  Other columns are not read.  Integers must lie within 2^40 either way, else the job
    ends with an error.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    fitted = fit_whitening(vectors, components, dims, scale, chunk)
    schema = "id long, component int, deviation decimal(38,0), whitened double"
    if fitted is None:
        rows = spark.createDataFrame([], schema)
        n, error, explained = 0, 0.0, F.lit(0.0)
    else:
        rows = vectors.mapInArrow(whiten_task(spark.sparkContext.broadcast(fitted), dims, scale), schema)
        n, error = fitted.n, fitted.identity_error
        explained = F.element_at(F.array(*map(F.lit, fitted.explained.tolist())), F.col("component"))
    return rows.select(
        F.col("id").alias(id), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
