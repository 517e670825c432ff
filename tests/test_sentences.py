from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import sentences
from gleaner.operators import filters

CASES = [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("A title\nThen text. More", ["A title", "Then text.", "More"]),
    ("Mr. J. R. Smith met Dr. Who in Jan. He left.", ["Mr. J. R. Smith met Dr. Who in Jan. He left."]),
    ("The U.S. Army, e.g. Fort X, and so on etc. and more. End.", ["The U.S. Army, e.g. Fort X, and so on etc. and more.", "End."]),
    ("“Why?” he said. “No.” (Then he left.) She stayed.", ["“Why?” he said.", "“No.”", "(Then he left.)", "She stayed."]),
    ("It costs 3.50 at www.a.org today... Then 4.", ["It costs 3.50 at www.a.org today...", "Then 4."]),
    ("Wait... . . . what", ["Wait... . . . what"]),
    ("वह आया। फिर वह गया॥ अंत", ["वह आया।", "फिर वह गया॥", "अंत"]),
    ("डॉ. शर्मा आए। प्रो. वर्मा गए।", ["डॉ. शर्मा आए।", "प्रो. वर्मा गए।"]),
    ("वह आया।फिर गया. अब नहीं", ["वह आया।", "फिर गया.", "अब नहीं"]),
    ("你好。再见！", ["你好。", "再见！"]),
    ("Größe zählt. Über alles. äh. ja", ["Größe zählt.", "Über alles. äh. ja"]),
    ("a\ufdd0b. C\ufdd0. D", ["a\ufdd0b.", "C\ufdd0.", "D"]),
    ("One.  Two.\r\nThree.　", ["One.", "Two.", "Three."]),
    ("", []),
    (" \n\t ", []),
    (None, None),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = df.select("id", sentences(F.col("text")).alias("s")).orderBy("id").collect()
    for row, (text, want) in zip(got, CASES):
        assert row.s == want, text


@pytest.mark.parametrize("piece", ["A.", ". ", ".)", "Mr. ", "। ", "a. B", '"', "\n"])
def test_sentences_of_long_texts_take_time_in_proportion(spark, piece):
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "text string")
    start = time.time()
    df.select(F.sum(F.size(sentences(F.col("text"))))).collect()
    assert time.time() - start < 10


def test_punctuation_counts_sentences(spark):
    texts = ["A. B c", "वह आया। वह गया", "One. Two. Three.", "no end", "", None, "Mr. Who"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = filters.FilterCascade([filters.punctuation(0.5)]).scores(df).orderBy("id").collect()
    assert [r.punctuation for r in got] == [1.0, 0.5, 0.0, 1.0, None, None, 1.0]
    kept = filters.FilterCascade([filters.punctuation(0.5)])(df).select("id").orderBy("id").collect()
    assert [r.id for r in kept] == [1, 2]
