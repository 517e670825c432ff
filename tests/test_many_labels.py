"""Language and domain models with more labels than are held in memory at a time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.charmodel import CharacterModel
from gleaner.operators import classify


def test_blocks_of_labels_give_the_model_in_memory(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.concat("lang", F.lit("-"), "source").alias("label"))
    train = lambda **s: classify.train_language_model(docs, label_field="label", features=1 << 12, **s)
    whole, parts = train(), train(block_weights=8 << 12)
    assert isinstance(whole, CharacterModel) and isinstance(parts, classify.LabelTable) and len(list(parts.blocks())) > 1
    extra = docs.select("doc_id", "text", F.lit(1).alias("_row_id")).unionByName(spark.createDataFrame([(-1, None, 1), (-2, "", 1)], "doc_id long, text string, _row_id int"))
    one, two = ({r["doc_id"]: r for r in classify.predict(m, extra).collect()} for m in (whole, parts))
    assert set(one) == set(two) and all(one[i]["_label"] == two[i]["_label"] and abs(one[i]["_score"] - two[i]["_score"]) < 1e-9 for i in one)
    assert classify.predict(parts, extra).columns == [*extra.columns, "_score", "_label"]


def test_five_thousand_labels(spark):
    rng = random.Random(2)
    rows = [(i, f"l{i:04d}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    model = classify.train_character_model(df, "text", "label", (3,), 1 << 10, block_weights=1 << 21)
    assert isinstance(model, classify.LabelTable) and len(model.labels) == 5000 and len(list(model.blocks())) == 3
    some = df.filter("id % 25 = 0")
    found = classify.predict(model, some).collect()
    assert len(found) == 200 and sum(r["label"] == r["_label"] for r in found) > 195


def test_no_labels(spark):
    with pytest.raises(ValueError):
        classify.train_language_model(spark.createDataFrame([(None, "a")], "lang string, text string"))
