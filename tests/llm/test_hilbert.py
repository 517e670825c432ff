from __future__ import annotations

from itertools import product

import pytest
from corpus import corpus, frame
from pyspark.sql import functions as F

from gleaner.llm.hilbert import hilbert_index, hilbert_shards, shard_bounds


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 3), (3, 2), (3, 1), (4, 2)])
def test_curve_visits_every_point_by_unit_steps(spark, n, bits):
    rows = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(n)))
    places = {r["h"]: tuple(r)[:-1] for r in df.withColumn("h", hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect()}
    assert sorted(places) == list(range(len(rows)))
    path = [places[h] for h in range(len(rows))]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(path, path[1:]))


@pytest.mark.parametrize("shards", [1, 7, 200])
def test_shards_are_equal_runs_of_the_curve(spark, shards):
    docs = frame(spark, corpus()).drop("text")
    out = hilbert_shards(docs, ["n_chars"], ["lang", "source"], shards, ["doc_id"])
    rows = sorted(out.collect(), key=lambda r: (r["shard"], r["slot"]))
    assert len(rows) == docs.count() and set(docs.columns) < set(out.columns)
    curve = [r["curve"] for r in rows]
    assert curve == sorted(curve)
    sizes = {s: [r["slot"] for r in rows if r["shard"] == s] for s in range(shards)}
    assert all(slots == list(range(len(slots))) for slots in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    bounds = shard_bounds(out, ["n_chars"]).collect()
    assert sum(r["n_rows"] for r in bounds) == len(rows)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, None, None), (1, 5, "a"), (1, 5, "a"), (2, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, size long, lang string")
    assert sorted((r["shard"], r["slot"]) for r in hilbert_shards(df, ["size"], ["lang"], 2, ["doc_id"]).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert hilbert_shards(df.limit(0), ["size"], ["lang"], 2, ["doc_id"]).count() == 0


def test_main_path_is_native(spark, tmp_path):
    from gleaner.llm.queries import QUERIES

    for name in ("op5_line_dedup", "op6_hilbert_sharding"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
