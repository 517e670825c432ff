"""Centroid clustering (Lloyd) over subvector dictionaries, in exact integers.

Vectors become integers ``floor(scale * x)``.  A chunk of them is written once as one row: its dimensions are cut into
blocks, and each block is dictionary-encoded without loss into its distinct subvectors and a code per vector.  A round
works out the squared distance of every distinct subvector to every centroid's block once, and sums these partial
distances by code; the sums of a cluster come from counts per code in the same way.  The width of the blocks is chosen
per chunk, whichever needs the fewest operations: copies favour wide blocks, values of a small range narrow ones.

Each round reads the encoded table without a shuffle of vectors; a task returns one row per cluster and dimension, whatever it
read, and the driver holds the centroids alone.  All arithmetic is in integers, so the result does not depend on the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.vectors import integer_vectors
from gleaner.session import discard, materialize, scratch_path

CHUNK = 4096  # vectors in an encoded row; at most 65536, as codes have 16 bits
WIDTHS = (1, 2, 4, 8, 16)
SLAB = 64  # centroids whose partial distances are held at a time
LIMIT = 1 << 27  # of a component's integer: 64 squared differences then fit in 64 bits

ENCODED = "ids array<long>, width int, sizes array<int>, entries array<long>, codes binary"
_ENCODED = pa.schema(
    [("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("sizes", pa.list_(pa.int32())), ("entries", pa.list_(pa.int64())), ("codes", pa.binary())]
)


@dataclass
class Chunk:
    """``entries``: the distinct subvectors, block after block; ``codes``: per block and vector its row in them."""

    width: int
    sizes: np.ndarray
    entries: np.ndarray
    codes: np.ndarray

    @property
    def block(self) -> np.ndarray:
        """The block of every entry."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def first(self) -> np.ndarray:
        """The first entry of every block."""
        return np.cumsum(self.sizes) - self.sizes


def encode(x: np.ndarray, widths: Sequence[int] = WIDTHS) -> Chunk:
    """The vectors ``x`` over dictionaries of the width that needs the fewest operations a centroid."""
    n, dims = x.shape
    best, least = None, None
    for width in (w for w in widths if dims % w == 0):
        entries, codes, sizes = [], [], []
        for at in range(0, dims, width):
            block = np.ascontiguousarray(x[:, at : at + width])
            if width == 1:
                distinct, code = np.unique(block[:, 0], return_inverse=True)
                distinct = distinct.reshape(-1, 1)
            else:
                distinct, code = np.unique(block.view(np.dtype((np.void, 8 * width)))[:, 0], return_inverse=True)
                distinct = distinct.view(np.int64).reshape(-1, width)
            entries.append(distinct)
            codes.append(code.astype(np.uint16))
            sizes.append(len(distinct))
        cost = 3 * sum(sizes) * width + 2 * n * len(sizes)  # subtract, square, add per entry; look up, add per code
        if least is None or cost < least:
            least = cost
            best = Chunk(width, np.array(sizes), np.concatenate(entries), np.stack(codes))
    return best


def nearest(chunk: Chunk, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector, the smaller number of equally near ones, and the squared distance."""
    n = chunk.codes.shape[1]
    cluster, distance = np.zeros(n, np.int32), np.full(n, np.iinfo(np.int64).max)
    block, first = chunk.block, chunk.first
    for low in range(0, len(centroids), SLAB):
        slab = centroids[low : low + SLAB].reshape(-1, len(chunk.sizes), chunk.width)
        partial = np.zeros((len(chunk.entries), len(slab)), np.int64)
        for k in range(chunk.width):
            partial += (chunk.entries[:, k, None] - slab[:, block, k].T) ** 2
        total = np.zeros((n, len(slab)), np.int64)
        for b, code in enumerate(chunk.codes):
            total += partial[first[b] + code.astype(np.int64)]
        at = total.argmin(axis=1)
        value = total[np.arange(n), at]
        nearer = value < distance
        cluster[nearer], distance[nearer] = at[nearer] + low, value[nearer]
    return cluster, distance


def cluster_sums(chunk: Chunk, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sum of the vectors of every cluster, by counts per code."""
    out = np.zeros((k, len(chunk.sizes) * chunk.width), np.int64)
    for b, (first, size, code) in enumerate(zip(chunk.first, chunk.sizes, chunk.codes)):
        counts = np.bincount(cluster.astype(np.int64) * size + code, minlength=k * size).reshape(k, size)
        out[:, b * chunk.width : (b + 1) * chunk.width] = counts @ chunk.entries[first : first + size]
    return out


def encode_task(dims: int, scale: int, chunk: int):
    """For ``mapInArrow``: rows of ``id`` and ``vector`` to encoded chunks; what is no whole vector goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encoded(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
            c = encode(x)
            row = [ids], [c.width], [c.sizes.tolist()], [c.entries.reshape(-1)], [c.codes.tobytes()]
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(([ids.to_pylist()], *row[1:]), _ENCODED)], schema=_ENCODED)

        held_ids, held = pa.array([], pa.int64()), np.zeros((0, dims), np.int64)
        for batch in batches:
            fit, x = integer_vectors(batch.column(1), dims, scale, LIMIT)
            held_ids = pa.concat_arrays([held_ids, batch.column(0).filter(pa.array(fit))])
            held = np.concatenate([held, x])
            while len(held) >= chunk:
                yield encoded(held_ids[:chunk], held[:chunk])
                held_ids, held = held_ids[chunk:], held[chunk:]
        if len(held):
            yield encoded(held_ids, held)

    return run


def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Chunk]]:
    ids, sizes, entries = batch.column("ids"), batch.column("sizes"), batch.column("entries")
    for i in range(batch.num_rows):
        width, blocks = batch.column("width")[i].as_py(), sizes[i].values.to_numpy().astype(np.int64)
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(len(blocks), -1)
        yield ids[i].values, Chunk(width, blocks, entries[i].values.to_numpy().reshape(-1, width), codes)


def round_task(shared):
    """For ``mapInArrow``: per cluster, the sum of each dimension and, as dimension -1, the number of vectors."""
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        k, dims = centroids.shape
        totals = np.zeros((k, dims + 1), dtype=object)  # Python's integers: no sum is too large
        for batch in batches:
            for _, chunk in chunks_of(batch):
                cluster, _ = nearest(chunk, centroids)
                totals[:, 1:] += cluster_sums(chunk, cluster, k)
                totals[:, 0] += np.bincount(cluster, minlength=k)
        place = np.indices(totals.shape).reshape(2, -1).astype(np.int32)
        yield pa.record_batch([pa.array(place[0]), pa.array(place[1] - 1), pa.array([Decimal(int(v)) for v in totals.reshape(-1)], schema.field("total").type)], schema=schema)

    return run


def assign_task(shared):
    """For ``mapInArrow``: id, cluster and squared distance of every vector."""
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, chunk in chunks_of(batch):
                cluster, distance = nearest(chunk, shared.value)
                yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], schema=schema)

    return run


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The integers of the ``k`` whole vectors of smallest ``sha256(seed:id)``; equal ids by their components."""
    entry = F.transform("vector", lambda x: x.cast("double"))
    finite = F.forall(entry, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = vectors.filter((F.size("vector") == dims) & finite)
    integers = F.transform(entry, lambda x: F.floor(x * scale).cast("long"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = whole.select(name.alias("name"), F.col("vector")).orderBy(F.col("name").asc_nulls_last(), "vector").limit(k)
    # The order is that of the vectors; their integers are worked out for the k rows only.
    found = [r["x"] for r in rows.select(integers.alias("x")).collect()]
    return np.array(found, np.int64).reshape(len(found), dims)


@dataclass
class Clustering:
    """``assigned``: ``(id, cluster, distance)`` of every whole vector, a written table; ``centroids``: their integers."""

    assigned: DataFrame
    centroids: np.ndarray

    def names(self) -> list[str]:
        """sha256 of each centroid's components, in decimal and joined by commas."""
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.centroids.tolist()]

    def described(self) -> DataFrame:
        """``assigned`` with the summed distances of the cluster and of all, and the centroid's name."""
        spark = self.assigned.sparkSession
        inertia = {r["cluster"]: int(r["total"]) for r in self.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
        rows = [(c, Decimal(inertia.get(c, 0)), Decimal(sum(inertia.values())), name) for c, name in enumerate(self.names())]
        table = spark.createDataFrame(rows, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
        return self.assigned.join(F.broadcast(table), "cluster")  # one row per centroid, a parameter


def cluster_vectors(
    df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK
) -> Clustering:
    """Cluster the vectors of ``df`` into at most ``k`` clusters by ``rounds`` of Lloyd's algorithm.

    Left out are rows whose vector is null, has not ``dims`` components, or holds a null or non-finite one.  The first
    centroids are the ``k`` vectors of smallest ``sha256(seed:id)``; with fewer vectors there are as many centroids.
    A vector belongs to the nearest centroid, of equally near ones to that of the smaller number.  Each round replaces a
    centroid by the floor of its vectors' mean; one without vectors stays.  Repeated rows count as often as they come; a
    row without an id is clustered as any other and is the last to become a first centroid.  No rows give no rows.  Other
    columns are not read.  A component's integer must lie within 2^27 either way, else the job ends with an error.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    path = scratch_path(spark, "subvectors")
    encoded = materialize(vectors.mapInArrow(encode_task(dims, scale, chunk), ENCODED), "subvectors", path)
    centroids = first_centroids(vectors, k, dims, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)  # k times dims numbers
        parts = encoded.mapInArrow(round_task(shared), "cluster int, dim int, total decimal(38,0)")
        totals = {(r["cluster"], r["dim"]): int(r["total"]) for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect()}
        moved = centroids.copy()
        for c in range(len(centroids)):
            if count := totals.get((c, -1), 0):
                moved[c] = [totals[c, d] // count for d in range(dims)]
        shared.unpersist()
        if (moved == centroids).all():  # every further round would repeat this one
            break
        centroids = moved
    shared = spark.sparkContext.broadcast(centroids)
    assigned = materialize(encoded.mapInArrow(assign_task(shared), "id long, cluster int, distance long"), "assigned")
    discard(spark, path)
    return Clustering(assigned.withColumnRenamed("id", id), centroids)
