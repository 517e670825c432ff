from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ordinals, sampling
from gleaner.sources import writers


def test_samples_of_any_size(spark):
    df = spark.range(3000).withColumn("text", F.lit("x")).repartition(5)
    ranked = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for n in (0, 1, 2, 1499, 2999, 3000, 3001):
        assert {r.id for r in sampling.sample_exactly(df, n, "id").collect()} == set(ranked[:n])


def test_sample_of_odd_keys(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a",), ("b",)], "k string")
    assert sampling.sample_exactly(df, 5, "k").count() == 5
    assert 3 <= sampling.sample_exactly(df, 3, "k").count() <= 4  # rows of one key stay together
    assert sampling.sample_exactly(df.limit(0), 3, "k").count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_first_n_either_way(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    df = spark.range(2000).select((F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b")).repartition(6)
    ranked = sorted((i % 7, str(i)) for i in range(2000))
    for n in (1, 700, 1999, 2000, 2001):
        assert {tuple(r) for r in sampling.first_n(df, n, ["a", "b"]).collect()} == set(ranked[:n])
    assert sampling.first_n(df.limit(0), 3, ["a", "b"]).count() == 0


def test_keys_at_places(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k")).repartition(7)
    ordered = ordinals.OrderedKeys(df, "k")
    assert ordered.total == 1000
    for place in (0, 1, 499, 999):
        assert [r.k for r in df.filter(ordered.key == ordered.at(place)).collect()] == [3 * place]
    for place in (-1, 1000):
        with pytest.raises(IndexError):
            ordered.at(place)


def test_contiguous_split_moves_no_row(spark, tmp_path):
    spark.range(999).select((998 - F.col("id")).alias("id"), F.lit("words").alias("text")).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    out = ordinals.split_by_order(df, {"a": 0.5, "b": 0.25, "c": 0.25}, "id")
    want = ["a"] * 499 + ["b"] * 250 + ["c"] * 250
    assert [r.split for r in out.orderBy("id").collect()] == want
    main = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in main and "Join" not in main and "Sort" not in main.split("scalar-subquery")[0]
    empty = ordinals.split_by_order(df.limit(0), {"a": 0.5, "b": 0.5}, "id")
    assert empty.columns == ["id", "text", "split"] and empty.count() == 0


@pytest.mark.parametrize("file_type", ["json", "parquet"])
def test_folders_are_counted_without_a_second_run(spark, tmp_path, file_type):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = [("fr", "a\nb"), ("fr", None), (None, "c"), ("d/e f", "g"), ("", "h")]
    df = spark.createDataFrame(rows, "lang string, text string").mapInArrow(counted, "lang string, text string")
    counts = writers.separate_by_field(df, f"{tmp_path}/{file_type}", "lang", file_type)
    assert {(r.lang, r.n_documents) for r in counts.collect()} == {("fr", 2), (None, 2), ("d/e f", 1)}
    assert runs.value == len(rows)
    none = writers.separate_by_field(df.filter("text = 'zz'"), f"{tmp_path}/none-{file_type}", "lang", file_type)
    assert none.columns == ["lang", "n_documents"] and none.count() == 0
