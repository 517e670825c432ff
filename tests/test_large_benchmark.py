"""Decontamination with a benchmark that is joined instead of shared."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.operators import decontaminate


def rows(spark, n, seed, n_words):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "delta,", "é", "x1", "zeta-eta"]
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, n_words))), i) for i in range(n)], "id long, text string, _row_id long")


def test_join_equals_sharing(spark):
    docs, tasks = rows(spark, 300, 1, 60), rows(spark, 400, 2, 12).select("text")
    for call in (decontaminate.contaminated_positions, decontaminate.remove_contaminated_documents, decontaminate.remove_contaminated_sections):
        few, many = (call(docs, tasks, 7, "id", block_chars=b) for b in (10**7, 1))
        few, many = (sorted(map(tuple, df.select(*few.columns).collect())) for df in (few, many))
        assert few and few == many


def test_the_sketch_has_one_size_and_loses_nothing(spark):
    for n in (20, 2000):
        tasks = rows(spark, n, 3, 30).select("text").distinct()
        passages = decontaminate.passage_table(tasks, 5)
        bits = decontaminate.sketch(passages)
        assert len(bits) == decontaminate.SKETCH_BITS // 8
        hashes = np.array([r["hash"] for r in passages.collect()], np.int64).view(np.uint64)
        at = decontaminate._bits(hashes)
        assert (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all()


def test_a_passage_that_a_third_of_the_documents_hold(spark):
    passage = "this passage of the test is copied into very many of the documents here"
    docs = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("so "), F.lit(passage))).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    tasks = spark.createDataFrame([(passage.upper(),), ("another one",)], "text string")
    left = decontaminate.remove_contaminated_documents(docs, tasks, 13, "id", block_chars=1)
    assert {r["id"] for r in left.select("id").collect()} == {i for i in range(3000) if i % 3}
