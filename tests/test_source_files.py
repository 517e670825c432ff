from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.sources.readers import read_documents
from gleaner.sources.writers import write_documents


def _written(folder) -> list[str]:
    return sorted(p.name for p in Path(folder).iterdir() if not p.name.startswith((".", "_")))


def _rows(spark, folder):
    return sorted(tuple(r) for r in read_documents(spark, str(folder), "json", "id bigint, file_name string").collect())


def test_a_file_per_source_of_its_name(spark, tmp_path):
    names = ["a.json", "b c.jsonl", "d=e%2F.json.gz", "ü.parquet", "plain", "v1.2", None]
    df = spark.createDataFrame([(i, names[i % len(names)]) for i in range(70)], "id bigint, file_name string").repartition(5)
    write_documents(df, str(tmp_path / "out"), write_to_filename=True)
    assert _written(tmp_path / "out") == ["a.json", "b c.json", "d=e%2F.json", "plain.json", "unnamed.json", "v1.2.json", "ü.json"]
    assert (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("_writing*"))
    assert _rows(spark, tmp_path / "out") == sorted(((i, names[i % len(names)]) for i in range(70)))
    back = read_documents(spark, str(tmp_path / "out"), "json", "id bigint, file_name string").select("*", F.col("_metadata.file_name").alias("at"))
    assert {r.at for r in back.filter("file_name = 'a.json'").collect()} == {"a.json"}


def test_a_large_source_comes_in_numbered_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") < 10, "small.json").otherwise("hot.json").alias("file_name"))
        write_documents(df.repartition(8), str(tmp_path / "out"), write_to_filename=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = _written(tmp_path / "out")
    hot = [f for f in files if f.startswith("hot")]
    assert len(hot) > 1 and hot == [f"hot-{k:05d}.json" for k in range(len(hot))] and set(files) - set(hot) == {"small.json"}
    assert len(_rows(spark, tmp_path / "out")) == 20_000


def test_names_that_differ_in_their_endings_lose_no_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.json"), (2, "a.parquet"), (3, "a-00000.json")], "id bigint, file_name string")
    write_documents(df, str(tmp_path / "out"), write_to_filename=True)
    assert [r[0] for r in _rows(spark, tmp_path / "out")] == [1, 2, 3]


def test_modes(spark, tmp_path):
    out = str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a.json")], "id bigint, file_name string")
    write_documents(one, out, write_to_filename=True)
    write_documents(one.withColumn("id", F.lit(2)), out, write_to_filename=True, mode="append")
    assert len(_written(out)) == 2 and [r[0] for r in _rows(spark, out)] == [1, 2]
    write_documents(one, out, write_to_filename=True, mode="ignore")
    with pytest.raises(FileExistsError):
        write_documents(one, out, write_to_filename=True, mode="error")
    assert [r[0] for r in _rows(spark, out)] == [1, 2]
    # Rows read from the folder may be written to it: the plan has ended when the old files go.
    again = read_documents(spark, out, "json", "id bigint, file_name string").withColumn("id", F.col("id") + 10)
    write_documents(again, out, write_to_filename=True)
    assert _written(out) == ["a.json"] and [r[0] for r in _rows(spark, out)] == [11, 12]


def test_an_empty_table(spark, tmp_path):
    write_documents(spark.createDataFrame([], "id bigint, file_name string"), str(tmp_path / "out"), write_to_filename=True)
    assert _written(tmp_path / "out") == [] and (tmp_path / "out" / "_SUCCESS").exists()
