"""Blocks of benchmark items that are collected to the driver."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa

from gleaner.llm import wumanber


def test_equal_items_are_collected_once(spark, monkeypatch):
    seen = []
    build = wumanber.build_patterns
    monkeypatch.setattr(wumanber, "build_patterns", lambda rows, size: seen.append(rows) or build(rows, size))
    text = " ".join(f"w{i}" for i in range(13))
    items = spark.createDataFrame([("a", text)] * 50 + [("b", text), (None, text), ("c", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, text + " more"), (2, "other words")], "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in wumanber.benchmark_hits(docs, items).collect()}
    assert sorted(row for rows in seen for row in rows) == [("", text), ("a", text), ("b", text)]
    assert found[1]["items"] == ["", "a", "b"] and found[1]["n_hit"] == 13 and found[2]["n_hit"] == 0


def test_blocks_give_what_one_pass_gives(spark):
    rng = random.Random(6)
    vocabulary = ["a", "B", "c1", "é", "dd"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = spark.createDataFrame([(i, prose(rng.randint(0, 80)), "x", i) for i in range(200)] + [(None, None, "x", 1), (7, "", "x", 2)], "doc_id long, text string, found string, _row_id int")
    items = spark.createDataFrame([(i % 90, prose(rng.randint(0, 30))) for i in range(120)], "item_id long, text string")
    one = wumanber.benchmark_hits(docs, items, size=6, out="hits")
    many = wumanber.benchmark_hits(docs, items, size=6, out="hits", block_windows=100)
    assert one.columns == many.columns == [*docs.columns, "hits"]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    # A pass leaves no broadcast behind in the plan of the result: it reads what the passes wrote.
    assert "ArrowEvalPython" not in many._jdf.queryExecution().executedPlan().toString()


def test_patterns_that_end_alike_are_told_apart_by_their_beginnings():
    rng = random.Random(1)
    text = " ".join(rng.choice(["red", "fox", "end", "of", "line"]) for _ in range(150_000))
    words = wumanber.cut_words(*wumanber.texts_of(pa.array([text])), wumanber.NON_ALNUM, wumanber.LOWER)
    took = []
    for n in (2000, 8000):
        rows = [(str(i), " ".join(f"p{i}x{j}" for j in range(11)) + " of line") for i in range(n)]
        (patterns,) = wumanber.build_patterns(rows, 13)
        start = time.perf_counter()
        assert len(patterns.search(words, 1)[0]) == 0
        took.append(time.perf_counter() - start)
    assert took[1] < 3 * took[0] + 0.3


def test_words_are_compared_by_their_bytes():
    cut = lambda *t: wumanber.cut_words(*wumanber.texts_of(pa.array(t)), wumanber.NON_ALNUM, wumanber.LOWER)
    a, b = cut("one two Three four é"), cut("one twO three fourth è")
    assert wumanber.same_words(a, np.arange(5), b, np.arange(5)).tolist() == [True, True, True, False, False]
    # Even where every hash is the same, only equal words are an occurrence.
    (patterns,) = wumanber.build_patterns([("i", "one two three")], 13)
    fake = cut("one two three one two tree")._replace(hashes=np.resize(patterns.words.hashes, 6))
    assert patterns.search(fake, 1)[0].tolist() == [0]
