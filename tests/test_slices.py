"""What a Python worker holds at a time is bounded, whatever the size of the engine's record batches."""

from __future__ import annotations

from unittest.mock import Mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import pii, slices
from gleaner.functions.minhash import minhash, shingle_hashes
from gleaner.functions.modify import reformat_unicode
from gleaner.functions.ngrams import repetition
from gleaner.operators import similarity_join

ODD = ["", None, "a", "नमस्ते दुनिया " * 40, "x" * 5000]


@pytest.fixture(scope="module")
def one_batch(spark):
    """3,000 rows of 1,000 characters, and odd ones, that come to Python as one record batch."""
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.substring(F.md5((F.col("id") * 1000 + i).cast("string")), 1, 9)), " ")
    rows = spark.range(0, 3000, numPartitions=1).select("id", text.alias("text"))
    odd = spark.createDataFrame([(3000 + i, t) for i, t in enumerate(ODD)], "id long, text string")
    yield rows.unionByName(odd).coalesce(1).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_spans_hold_all_rows_in_bounded_slices():
    sizes = np.array([0, 10, 500, 2000, 0, 0, 300, 300, 300])
    found = list(slices.spans(sizes, 1000))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or (sizes[a:b] + 64).sum() <= 1000 for a, b in found) and (3, 4) in found
    assert list(slices.spans(np.zeros(0, np.int64))) == []
    assert len(list(slices.spans(np.zeros(100_000, np.int64)))) > 1


def test_function_sees_slices_of_a_batch(spark, one_batch):
    """Each value is the size of the slice that the text came in."""
    seen = slices.by_slices(lambda texts: pa.array([sum(len((t or "").encode()) for t in texts)] * len(texts), pa.int64()), "long")
    rows = one_batch.select("id", seen("text").alias("n")).collect()
    assert [r["id"] for r in rows] == list(range(3000 + len(ODD)))
    assert len({r["n"] for r in rows}) > 1 and max(r["n"] for r in rows) <= slices.SLICE_BYTES


def worker_function(monkeypatch, make):
    """What a column function runs in a worker, over record batches."""
    caught, udf = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, returns: caught.append(f) or udf(f, returns))
    make(F.col("text"))
    return caught[0]


LONG_BATCH = pa.array([f"Maria Garcia saw café {i} " * 100 for i in range(4000)])


@pytest.mark.parametrize(
    "make",
    [
        lambda text: minhash(text),
        lambda text: similarity_join.shingle_sets(text, 24),
        lambda text: pii.redact(text, ["PERSON"]),
        lambda text: pii.analyze(text),
        lambda text: repetition(text, (2, 3, 4), (5,)),
        reformat_unicode,
    ],
)
def test_results_leave_before_the_next_slice(spark, monkeypatch, make):
    """As one batch of results, 10 MB of text came out as a whole."""
    out = list(worker_function(monkeypatch, make)(iter([LONG_BATCH])))
    assert sum(map(len, out)) == len(LONG_BATCH) and max(map(len, out)) < len(LONG_BATCH) / 8


def test_prefixes_leave_in_slices():
    sets = Mock(schema={"id": Mock(dataType=Mock(simpleString=lambda: "bigint"))})
    sets.sparkSession.sparkContext.broadcast = lambda counts: Mock(value=counts)
    sets.select.return_value.mapInArrow = lambda function, schema: function
    hashes = np.random.default_rng(0).integers(0, 1 << 62, (2000, 1500)).cumsum(axis=1)
    batch = pa.record_batch([pa.array(range(2000)), slices.list_array(list(hashes), pa.int64())], ["id", "shingles"])
    out = list(similarity_join.prefixes(sets, "id", 0.8, np.zeros(similarity_join.CELLS, np.int64))(iter([batch])))
    assert len(out) > 4 and sum(len(b) for b in out) == 2000 * 301
    ids = pa.concat_arrays([b.column(0) for b in out]).to_numpy()
    assert (ids == np.repeat(np.arange(2000), 301)).all()


def test_sets_and_signatures_of_odd_texts(spark, one_batch):
    sets = one_batch.filter("length(text) > 0").select("id", similarity_join.shingle_sets(F.col("text"), 24).alias("shingles"))
    found = {r["id"]: r["shingles"] for r in sets.collect()}
    assert len(found) == 3000 + len(ODD) - 2
    for i, text in enumerate(ODD):
        assert not text or found[3000 + i] == np.unique(shingle_hashes(text, 24)).view(np.int64).tolist()
    signed = {r["id"]: r["s"] for r in one_batch.select("id", minhash(F.col("text")).alias("s")).collect()}
    assert len(signed) == 3000 + len(ODD) and all((s is None) == (i in (3000, 3001)) and (s is None or len(s) == 260) for i, s in signed.items())
