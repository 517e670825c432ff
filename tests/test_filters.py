from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.ngrams import repetition_frame
from gleaner.functions.text import compute_once, hash_unit, strip, words
from gleaner.operators import filters
from gleaner.operators.compose import Modify, ScoreFilter, python_modifier
from gleaner.plans.curation import HEURISTICS

texts = st.lists(st.sampled_from("a bb ccc d\n ee".split(" ") + [" ", "a"]), max_size=40).map(" ".join)


def brute_top(text: str, n: int) -> float:
    w = text.split()
    counts = Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    best = max(((c, len(g)) for g, c in counts.items() if c > 1), default=(0, 0))
    return best[0] * best[1] / len(text)


def brute_duplicate(text: str, n: int) -> float:
    w, seen, inside = text.split(), set(), set()
    for i in range(len(w) - n + 1):
        gram = tuple(w[i : i + n])
        if gram in seen:
            inside.update(range(i, i + n))
        seen.add(gram)
    return sum(len(w[i]) for i in inside) / len(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_ngram_scores_equal_brute_force(batch):
    got = repetition_frame(batch, (1, 2, 3, 4), (2, 3, 5, 6))
    for i, text in enumerate(batch):
        if text:
            for n in (1, 2, 3, 4):
                assert got[f"top_{n}"][i] == pytest.approx(brute_top(text, n))
            for n in (2, 3, 5, 6):
                assert got[f"dup_{n}"][i] == pytest.approx(brute_duplicate(text, n))
        else:
            assert got.iloc[i].isna().all()


def rows(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def kept(spark, filt, *values):
    df = ScoreFilter(filt)(rows(spark, *values))
    return [r.id for r in df.orderBy("id").collect()]


def test_white_space_is_unicode(spark):
    df = rows(spark, " a b\x1cc\n ", " \t\n", "")
    got = df.select(strip(F.col("text")), F.size(words(F.col("text")))).collect()
    assert [tuple(r) for r in got] == [("a b\x1cc", 3), ("", 0), ("", 0)]


def test_terminators(spark):
    values = ["a.", "a! ", "a?\n", 'a"', "a”", "a,", "", None, "  "]
    assert kept(spark, filters.complete_document(), *values) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("filt", "values", "expected"),
    [
        (filters.word_count(min_words=2, max_words=3), ["a", "a b", "a b c", "a b c d", None], [1, 2]),
        (filters.symbols_to_words(0.5), ["a b # c", "a ... … #", "a b ... c"], [0, 2]),
        (filters.numbers(0.5), ["ab12", "a123", "क१२३"], [0]),
        (filters.urls(0.2), ["see http://a.b/c now", "x" * 80 + " http://a.b/cc"], [1]),
        (filters.white_space(0.25), ["a  b", "aaa b", ""], [1]),
        (filters.parentheses(0.1), ["(a)[b]{c}", "aaaaaaaaaaaaaaaaaaa (a"], [1]),
        (filters.boilerplate(), ["Terms of Use\n\nb\n\nc", "a\n\nterms of use\n\nb\n\nc", "a\n\nlorem ipsum\n \nlorem ipsum\n\nb"], [1]),
        (filters.unique_lines(0.7), ["a\na\nb", "a\nb\nc", "a\n\n\nb"], [1, 2]),
        (filters.unique_paragraphs(0.7), ["a\n\na\n\nb", "a\n \nb\n\nc"], [1]),
        (filters.unique_line_chars(0.8), ["long line\nlong line\na", "a\na\n" + "x" * 30], [1]),
        (filters.unique_paragraph_chars(0.8), ["long one\n\nlong one", "a\n\na\n\n" + "x" * 30], [1]),
        (filters.punctuation(0.5), ["a\nb\nc.", "a.\nb! \nc"], [1]),
        (filters.mean_word_length(3, 10), ["a b", "abc abcd", "a" * 30], [1]),
        (filters.long_word(5), ["abcde a", "abcdef a"], [0]),
        (filters.ellipsis(0.3), ["a...\nb…\nc", "a...\nb\nc\nd"], [1]),
        (filters.bullets(0.5), ["- a\n* b\n• c", " - a\nb\nc"], [1]),
        (filters.top_ngram(2, 0.2), ["a b a b a b a b", "a b c d e f g h i"], [1]),
        (filters.duplicate_ngram(5, 0.15), ["a b c d e a b c d e", "a b c d e f g h i"], [1]),
    ],
    ids=lambda v: v.name if isinstance(v, filters.TextFilter) else "",
)
def test_filter_rules(spark, filt, values, expected):
    assert kept(spark, filt, *values) == expected


def test_config_takes_class_paths_and_keeps_order():
    config = {
        "input_field": "body",
        "filters": [
            {"name": "some.package.WordCountFilter", "params": {"min_words": 3}},
            {"name": "some.package.RepeatedLinesFilter", "params": {"max_repeated_line_fraction": 0.7}},
            {"name": "bullets"},
        ],
    }
    cascade = filters.cascade_from_config(config)
    assert [f.name for f in cascade.filters] == ["word_count", "unique_lines", "bullets"]
    assert cascade.text_field == "body"
    with pytest.raises(ValueError):
        filters.cascade_from_config({"filters": [{"name": "NoSuchFilter"}]})
    assert len(filters.build_filter_cascade(HEURISTICS).filters) == 25


def test_custom_filter_and_score_column(spark):
    filt = filters.custom_filter("chars", F.length, lambda s: s > 2)
    out = ScoreFilter(filt, score_field="n", score_type="double")(rows(spark, "abc", "a"))
    assert [tuple(r) for r in out.collect()] == [(0, "abc", 3.0)] and dict(out.dtypes)["n"] == "double"


def test_python_functions_as_filter_and_modifier(spark):
    df = rows(spark, "abc", "a", None)
    filt = filters.python_filter("ends", lambda t: float(len(t)), lambda s: s > 2)
    assert [r.id for r in ScoreFilter(filt)(df).collect()] == [0]
    out = Modify(python_modifier(str.upper))(df).orderBy("id").collect()
    assert [r.text for r in out] == ["ABC", "A", None]


def test_cascade_splits_each_text_once_and_python_runs_last(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = filters.build_filter_cascade(HEURISTICS)(df)._jdf.queryExecution().executedPlan().toString()
    for barrier in ("_words#", "_lines#", "_paragraphs#"):
        assert barrier in plan
    assert plan.count("split(text") == 3  # words, lines, paragraphs
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Generate")  # above it in the tree
    assert "Exchange" not in plan


def test_report_and_drops_agree_with_the_cascade(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cascade = filters.build_filter_cascade(HEURISTICS)
    left = cascade(df).count()
    assert cascade.dropped_by(df).filter("dropped_by IS NULL").count() == left
    assert cascade.report(df).orderBy(F.desc("step")).first().rows_out == left


def test_hash_unit_is_independent_of_partitions(spark):
    df = spark.range(500)
    a, b = (df.repartition(n).filter(hash_unit(42, "id") < 0.1) for n in (1, 7))
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_compute_once_keeps_rows(spark):
    df = compute_once(spark.range(5), twice=F.col("id") * 2)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(i, 2 * i) for i in range(5)]


def test_python_filter_runs_after_the_native_ones(spark):
    cascade = filters.FilterCascade([filters.python_filter("ends", lambda t: float(len(t)), lambda s: s > 2), filters.word_count(min_words=2)])
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    plan = cascade(df)._jdf.queryExecution().executedPlan().toString()
    python, words = plan.index("EvalPython"), plan.index("size(_words")
    assert python < words  # a plan is printed from the top: what runs later stands first
