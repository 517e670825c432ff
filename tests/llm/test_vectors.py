"""Clustering and whitening against plain versions in whole numbers."""

from __future__ import annotations

import hashlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from corpus import same
from pyspark.sql import functions as F

from gleaner.llm import bitslices, subvectors
from gleaner.llm.queries import QUERIES
from gleaner.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id int, n int, x string"
SF = "/root/testdata/sf0.001"


def vectors(seed=1, n=150, dims=64):
    """Copies, near copies, ties, nulls, null and non-finite entries, other lengths, repeated rows, missing ids."""
    random = np.random.default_rng(seed)
    rows = [(i, random.normal(0, 0.2, dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, None)]
    rows += [(n + 50, None), (n + 51, [None, *rows[0][1][1:]]), (n + 52, [float("nan"), *rows[0][1][1:]]), (n + 53, [float("-inf"), *rows[0][1][1:]])]
    rows += [(n + 54, []), (n + 55, rows[0][1][1:]), (n + 56, [*rows[0][1], 0.5]), (n + 57, [0.0] * dims), (n + 58, [-0.0] * dims)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2, 3, "x") for i, v in rows], SCHEMA).repartition(3)


def whole(rows, dims, scale):
    out = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    return out


def plain_clusters(rows, k, rounds, dims=64, scale=1024):
    kept = whole(rows, dims, scale)
    name = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            members = [x for (_, x), (a, _) in zip(kept, at) if a == c]
            if members:
                centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    at = assign()
    total = Counter()
    for c, d in at:
        total[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total[c], sum(total.values()), names[c]) for (i, _), (c, d) in zip(kept, at)]


@pytest.mark.parametrize("k,rounds,chunk", [(8, 10, 4096), (5, 3, 32), (70, 2, 50), (1, 1, 10), (400, 2, 64)])
def test_clusters(spark, k, rounds, chunk):
    rows = vectors()
    got = subvectors.cluster_vectors(frame(spark, rows), k=k, rounds=rounds, chunk=chunk).described()
    got = got.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long"), F.col("inertia").cast("long"), "centroid_sha256")
    assert same(got.collect(), plain_clusters(rows, k, rounds))


def test_clusters_of_other_dimensions_and_of_nothing(spark):
    rows = vectors(2, 30, dims=6)
    got = subvectors.cluster_vectors(frame(spark, rows), k=3, rounds=4, dims=6).assigned
    assert same(got.collect(), [r[:3] for r in plain_clusters(rows, 3, 4, dims=6)])
    for empty in ([], [(1, None), (2, [1.0])]):
        found = subvectors.cluster_vectors(frame(spark, empty))
        assert found.described().collect() == [] and len(found.centroids) == 0


def test_clusters_equal_the_plain_version_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()][:120]
    got = subvectors.cluster_vectors(frame(spark, rows)).described().select("vec_id", "cluster", "distance", "centroid_sha256").collect()
    assert same(got, [(*r[:3], r[5]) for r in plain_clusters(rows, 8, 10)])


def test_encoding_is_lossless_and_picks_its_width():
    random = np.random.default_rng(0)
    varied = random.integers(-100, 100, (2000, 64))
    copies = varied[random.integers(0, 3, 2000)]
    for x in (varied, copies, varied[:1], np.zeros((7, 64), np.int64)):
        chunk = subvectors.encode(x)
        back = np.concatenate([chunk.entries[f + code.astype(int)] for f, code in zip(chunk.first, chunk.codes)], axis=1)
        assert (back == x).all()
    assert subvectors.encode(varied).width == 1 and subvectors.encode(copies).width == 16


def test_ties_go_to_the_smaller_number():
    chunk = subvectors.encode(np.array([[1, 0], [3, 0], [0, 5]]))
    cluster, distance = subvectors.nearest(chunk, np.array([[2, 0], [2, 0], [0, 0]]))
    assert cluster.tolist() == [0, 0, 2] and distance.tolist() == [1, 1, 25]


def test_too_large_a_component_is_an_error():
    with pytest.raises(ValueError):
        integer_vectors(pa.array([[1e30, 0.0]]), 2, 1024, subvectors.LIMIT)


@pytest.mark.parametrize("high", [2, 700, 1 << 31])
def test_cross_products_of_bit_planes(high):
    x = np.random.default_rng(high).integers(-high, high, (1000, 7))
    x[:, 3], x[:, 4] = 5, -x[:, 0]
    sums, products = bitslices.cross_products(x)
    big = x.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist() and (products == big.T @ big).all()


def test_packed_rows_come_back():
    x = np.array([[1, -2], [40_000, 3], [-32768, 32767], [1 << 40, 0]])
    assert sorted(map(tuple, bitslices.unpack_rows(bitslices.pack_rows(x), 2).tolist())) == sorted(map(tuple, x.tolist()))
    assert bitslices.unpack_rows(bitslices.pack_rows(x[:0]), 2).shape == (0, 2)


def plain_whitening(rows, dims, scale):
    kept = whole(rows, dims, scale)
    fit = [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(a - m) for a, m in zip(x, mean)] for x in fit])
    return kept, n, sums, centred, centred.T @ centred / n


@pytest.mark.parametrize("chunk", [16384, 50])
def test_whitening(spark, chunk):
    rows = vectors()
    kept, n, sums, centred, covariance = plain_whitening(rows, 64, 256)
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1][:4]
    got = bitslices.whiten(frame(spark, rows), chunk=chunk).collect()
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    deviation = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept]
    assert same([(r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1], deviation)
    for k in range(4):
        mine = [r for r in got if r["component"] == k + 1]
        assert np.allclose([r["explained"] for r in mine], values[k] / np.trace(covariance), rtol=1e-10)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_whitened_values_have_unit_covariance_and_are_projections(spark):
    rows = [(i, v) for i, v in vectors() if i is not None and i != 5]
    kept, n, sums, centred, covariance = plain_whitening(rows, 64, 256)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in bitslices.whiten(frame(spark, rows)).collect()}
    first = {tuple(x): i for i, x in reversed(kept)}
    table = np.array([[got[i, k] for k in range(1, 5)] for i in first.values()])
    assert np.abs(np.cov(table.T, bias=True) - np.eye(4)).max() < 1e-9
    x = np.array([[a - s / n for a, s in zip(v, sums)] for v in first])
    for k in range(4):
        direction = covariance @ np.linalg.lstsq(x, table[:, k], rcond=None)[0]
        direction /= np.linalg.norm(direction)
        value = np.linalg.norm(covariance @ direction)
        assert np.allclose(covariance @ direction, value * direction, atol=1e-6)
        assert np.allclose(np.abs(table[:, k]), np.abs(x @ direction) / np.sqrt(value), atol=1e-6)


def test_whitening_without_variance(spark):
    one = [0.25] * 64
    got = bitslices.whiten(frame(spark, [(1, one), (2, one), (3, None)])).collect()
    assert [(r["vec_id"], r["component"]) for r in sorted(got)] == [(i, k) for i in (1, 2) for k in (1, 2, 3, 4)]
    assert all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in got)
    # Vectors on a line have one component of variance.
    line = [(i, [i / 256] * 64) for i in range(5)]
    got = bitslices.whiten(frame(spark, line)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True), (4, True)}
    for empty in ([], [(1, None), (2, [1.0])]):
        assert bitslices.whiten(frame(spark, empty)).collect() == []


def test_whitening_query(spark):
    df = QUERIES["op12_embedding_whitening"](spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    kept, n, sums, _, _ = plain_whitening(rows, 64, 256)
    got = df.collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    assert same([(r["vec_id"], r["deviation"]) for r in got if r["component"] == 2], [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept])
