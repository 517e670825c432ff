"""The supervised classifier: its parameters, held-out accuracy, and SQL over the written weights."""

from __future__ import annotations

from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import supervised
from gleaner.operators.supervised import TextModel, features, train_supervised

SF = "/root/testdata/sf0.01"


def test_features_are_words_and_runs_of_words():
    found, counts = features("The cat the  CAT\nthe", 3, 1 << 30)
    grams = ["the", "cat", "the cat", "cat the", "the cat the", "cat the cat"]
    assert dict(zip(found.tolist(), counts.tolist())) == {crc32(g.encode()) % (1 << 30): n for g, n in zip(grams, (3, 2, 2, 2, 2, 1))}
    assert len(features("", 2, 8)[0]) == len(features(None, 2, 8)[0]) == 0


def test_steps_follow_the_gradient():
    """One step lowers the loss by the squared length of its numeric gradient, times the rate."""
    random = np.random.default_rng(0)
    embeddings, layer = random.normal(0, 0.5, (6, 4)), random.normal(0, 0.5, (3, 4))
    row = (1, np.array([0, 2, 5]), np.array([2, 1, 1]))

    def loss(e, o):
        z = o @ (row[2] / row[2].sum() @ e[row[1]])
        return np.log(np.exp(z).sum()) - z[1]

    gradient = []
    for which in (embeddings, layer):
        g = np.zeros_like(which)
        for at in np.ndindex(which.shape):
            for sign in (1, -1):
                which[at] += sign * 1e-5
                g[at] += sign * loss(embeddings, layer) / 2e-5
                which[at] -= sign * 1e-5
        gradient.append(g)
    moved = embeddings.astype(np.float32), layer.astype(np.float32)
    supervised.steps(*moved, [row], 0.01, 0.0)
    for new, old, g in zip(moved, (embeddings, layer), gradient):
        assert np.allclose(new, old - 0.01 * g, atol=1e-4)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    return docs.select("doc_id", "text", F.col("lang").alias("label")).persist()


def test_held_out_accuracy_and_parameters(spark, labelled):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    train, rest = labelled.filter(~held_out), labelled.filter(held_out).toPandas()

    def accuracy(**settings):
        model = train_supervised(train, **({"lr": 1.0, "dim": 16, "epoch": 20, "buckets": 1 << 14} | settings))
        best = np.array(model.labels)[model.probabilities(rest["text"].tolist()).argmax(axis=1)]
        return (best == rest["label"]).mean(), model

    good, model = accuracy()
    assert good > 0.95
    assert accuracy(part_rows=150, epoch=60)[0] > 0.9  # averaged over several parts, which takes more epochs
    slow, _ = accuracy(lr=1e-4, epoch=2)
    assert slow < good
    none, untrained = accuracy(epoch=0)
    assert np.isnan(untrained.weights).all() and np.allclose(untrained.probabilities(["a"]), 0.25)
    assert accuracy(dim=2, epoch=1)[1].weights.shape == model.weights.shape and not np.allclose(accuracy(dim=2, epoch=1)[1].weights, model.weights, equal_nan=True)
    assert np.isnan(accuracy(word_ngrams=1, epoch=1)[1].weights[:, 0]).sum() > np.isnan(model.weights[:, 0]).sum()


def test_the_model_does_not_depend_on_partitions(labelled):
    settings = dict(lr=0.5, dim=8, epoch=2, buckets=1 << 12, part_rows=100)
    one, two = (train_supervised(labelled.repartition(n), **settings) for n in (1, 7))
    assert np.array_equal(one.weights, two.weights, equal_nan=True)


def test_sql_scores_from_the_written_weights(spark, labelled, tmp_path):
    model = train_supervised(labelled, lr=0.5, dim=8, epoch=3, word_ngrams=2, buckets=1 << 12)
    model.save(spark, str(tmp_path / "model"))
    again = TextModel.load(spark, str(tmp_path / "model"))
    got = {r["doc_id"]: r["score"] for r in again.predict(labelled, "en", "text", "score").select("doc_id", "score").collect()}
    con = duckdb.connect()
    con.create_function("crc", lambda s: crc32(s.encode()), ["VARCHAR"], "BIGINT")
    rows = con.sql(rf"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)),
        gram AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
        z AS (SELECT doc_id, label, avg(weight) AS z FROM gram JOIN '{tmp_path}/model/weights/*.parquet' ON feature = crc(g) % 4096 GROUP BY ALL)
        SELECT doc_id, exp(max(z) FILTER (label = 'en')) / sum(exp(z)) FROM z GROUP BY doc_id""").fetchall()
    assert len(rows) == len(got) and all(abs(got[i] - s) < 1e-9 for i, s in rows)


def test_nulls_no_labels_and_limits(spark):
    df = spark.createDataFrame([("a b", "x"), (None, "y"), ("", "y"), ("c", None)], "text string, label string")
    model = train_supervised(df, lr=0.5, dim=4, epoch=3, buckets=64)
    assert model.labels == ["x", "y"] and np.allclose(model.probabilities([None, ""]), 0.5)
    with pytest.raises(ValueError):
        train_supervised(df.filter("label IS NULL"))
    with pytest.raises(ValueError):
        train_supervised(df, dim=1 << 12, buckets=1 << 16)


def test_means_are_added_up_as_parts_come():
    """A block's result leaves when the next block begins, and no earlier part is held by then."""
    random, dim, held = np.random.default_rng(1), 4, []
    parts = [(np.sort(random.choice(supervised.FEATURE_BLOCK, 50, False)), random.normal(size=(50, dim)).astype(np.float32)) for _ in range(30)]
    layers = [random.normal(size=(2, dim)).astype(np.float32) for _ in range(30)]

    def rows():
        for block in (-1, 0, 3):
            for part in range(30):
                used, numbers = (b"", layers[part]) if block < 0 else ((parts[part][0] + block * supervised.FEATURE_BLOCK).astype(np.int64).tobytes(), parts[part][1])
                held.append(block)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([part]), pa.array([used]), pa.array([numbers.tobytes()])], ["block", "part", "used", "numbers"])

    found = {}
    for out in supervised.mean_task(dim, 2)(rows()):
        block, used, numbers = (out.column(c)[0].as_py() for c in range(3))
        found[block] = np.frombuffer(used, np.int64), np.frombuffer(numbers, np.float32).reshape(-1, dim)
        assert len(held) == min(30 * len(found) + 1, 90)
    assert list(found) == [-1, 0, 3] and np.array_equal(found[-1][1], np.mean(layers, axis=0, dtype=np.float64).astype(np.float32))
    for block in (0, 3):
        for feature, numbers in zip(found[block][0] - block * supervised.FEATURE_BLOCK, found[block][1]):
            mine = [n[u == feature][0] for u, n in parts if feature in u]
            assert np.allclose(numbers, np.mean(mine, axis=0))
        assert len(found[block][0]) == len(set(np.concatenate([u for u, _ in parts])))


def test_texts_are_scored_in_slices(spark, labelled, monkeypatch):
    caught, udf = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, returns: caught.append(f) or udf(f, returns))
    TextModel(["x", "y"], np.zeros((64, 2)), 2).predict(labelled, "x", "text", "score")
    sizes = [len(out) for out in caught[0](iter([pa.array(["some words " * 100] * 5000)]))]
    assert sum(sizes) == 5000 and max(sizes) < 1000
