"""Addresses with a local part beyond the length of the standard."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.functions import pii


@pytest.mark.parametrize("local", ["a" * 64, "a" * 65, "first.last-" * 9 + "x", "b" * 200_000], ids=["64", "65", "parts", "200000"])
def test_email_with_a_long_local_part(spark, local):
    df = spark.createDataFrame([(f"to {local}@example.org now",)], "text string")
    row = df.select(pii.redact(F.col("text"), ["EMAIL_ADDRESS"]).alias("text"), pii.analyze(F.col("text"), ["EMAIL_ADDRESS"]).alias("spans")).first()
    assert row["text"] == "to <EMAIL_ADDRESS> now"
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(3, 3 + len(local) + 12)]
