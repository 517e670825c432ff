"""Registered queries against their SQL, or against the plain version where SQL cannot say it."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from corpus import base_quality, benchmark_hits, near_components, repeated_lines, same

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle_check import connect, normal  # noqa: E402

from gleaner.llm.queries import QUERIES  # noqa: E402
from gleaner.llm.sql import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    df, result = QUERIES[name](spark, SF), connect("0.001").sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(result.columns, result.fetchall())


def test_entry_offers_the_queries():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_row_counts(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_toxicity", "op3_license_scan", "op6_hilbert_sharding", "op8_quality_rules"):
        assert QUERIES[name](spark, SF).count() == n
    assert QUERIES["op4_html_extraction"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_pages_give_their_articles(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for row in QUERIES["op4_html_extraction"](spark, SF).collect():
        article = re.search("<article>(.*)</article>", pages[row["page_id"]], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article.replace("<br>", " ")))
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_pipeline_equals_the_plain_versions(spark):
    import corpus_pipeline
    import pyarrow as pa

    from gleaner.llm.quality import THRESHOLD, train_quality

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_quality(table, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    good = model.score(pa.array([t for _, t in docs])) >= THRESHOLD
    docs = [d for d, g in zip(docs, good) if g and not base_quality(d[1])[-1]]
    docs = [(i, text) for i, _, _, text in repeated_lines(docs)]
    docs = [d for d, r in zip(docs, near_components(docs, 5)) if r[3]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d, r in zip(docs, benchmark_hits(docs, items)) if not (r[2] and 20 * r[2] >= r[1])]

    stage_docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = corpus_pipeline.materialize(stage(spark, stage_docs, SF), f"test-{name}")
        assert stage_docs.columns == table.columns
    assert same(stage_docs.select("doc_id", "text").collect(), docs)
    assert stage_docs.filter("n_chars <> char_length(text)").count() == 0

    from tokenizers import Tokenizer

    from gleaner.llm.queries import default_tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    expected = []
    for i, t in docs:
        n = len(whole.encode(t, add_special_tokens=False).ids) + 1
        expected += [(i, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))]
    got = corpus_pipeline.run(spark, SF)
    assert same(got.select("doc_id", "piece", "start", "length").collect(), expected)
