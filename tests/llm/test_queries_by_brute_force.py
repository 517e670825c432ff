"""Queries without SQL against plain versions of the whole query, and the pipeline on odd tables."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from corpus import corpus, frame, same
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

from gleaner.llm import bbit, hilbert, toxicity  # noqa: E402
from gleaner.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_toxicity_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in labels if not held_out(r["doc_id"])], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, learnt)
    got = {r["doc_id"]: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        score = float(model.score(pa.array([r["text"]], pa.large_string()))[0])  # one text at a time
        mine = got[r["doc_id"]]
        assert abs(mine["score"] - score) < 1e-6 and mine["held_out"] == held_out(r["doc_id"])
        assert mine["predicted"] == int(mine["score"] >= 0.3)


def on_curve(point, bits):
    """Skilling's transform, step by step on Python's integers."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def spark_hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_sharding_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes = sorted(len((r["text"] or "").encode()) + 16 for r in rows)
    cuts = sorted({sizes[int(np.ceil(k / 16 * len(sizes))) - 1] for k in range(1, 16)})

    def key(r):
        size = len((r["text"] or "").encode()) + 16
        point = [sum(size >= c for c in cuts), spark_hash(r["lang"]) % 16, spark_hash(r["source"]) % 16]
        return on_curve(point, 4), spark_hash(r["text"]), r["doc_id"]

    expected, slots = [], Counter()
    for rank, r in enumerate(sorted(rows, key=key)):
        shard = rank * 40 // len(rows)
        expected.append((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), "rows", shard, slots[shard], None, key(r)[0]))
        slots[shard] += 1
    assert same(QUERIES["op6_hilbert_sharding"](spark, SF).collect(), expected)


def test_filters_on_several_dimensions_touch_few_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.octet_length("text").alias("size"), "lang", "source")
    sharded = hilbert.hilbert_shards(docs, ["size"], ["lang", "source"], 40, ["doc_id"])
    bounds = hilbert.shard_bounds(sharded, ["size", "lang", "source"]).collect()
    largest, rare = docs.approxQuantile("size", [0.9], 0)[0], "es"
    mean = docs.groupBy("lang").count().filter("lang = 'es'").first()["count"] / docs.count()
    by_size = [b for b in bounds if b["max_size"] >= largest]
    by_both = [b for b in by_size if b["min_lang"] <= rare <= b["max_lang"]]
    by_lang = sharded.filter(F.col("lang") == rare).select("shard").distinct().count()
    assert len(bounds) == 40 and len(by_size) <= 16 and len(by_both) <= 10
    # 25 documents a shard: dealt out at random, nearly every shard would hold one of the language.
    assert by_lang <= 20 < 40 * (1 - (1 - mean) ** 25)


def test_one_id_with_several_texts(spark):
    """Each text goes its own way: its links are found whichever row of the id comes first."""
    base, other = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, base), (1, other), (2, base + " x"), (3, other + " y"), (4, "nothing else"), (1, base)]
    for n in (1, 2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = {r["doc_id"]: r["component_id"] for r in bbit.near_duplicates(df).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    root = tmp_path_factory.mktemp("odd")
    frame(spark, corpus()).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def test_pipeline_on_an_odd_table(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(odd))
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == docs.columns
            kept = corpus_pipeline.materialize(out, f"odd-{name}")
            assert 0 < kept.count() <= docs.count()
            if name != "lines":
                assert kept.exceptAll(docs).count() == 0  # rows as they came
            docs = kept if name != "quality" else docs  # go on with the nulls, which the rules drop
    assert corpus_pipeline.run(spark, str(odd)).count() > 0


def test_pipeline_on_an_empty_table(spark, odd, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    except ValueError as error:  # no labelled text to learn from
        assert "label" in str(error)
