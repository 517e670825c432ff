"""Queries that read their whole input: whole texts and every row."""

from __future__ import annotations

import re

from gleaner.plans.catalog import QUERIES
from gleaner.plans.settings import MIN_LANGUAGE_SCORE

SF = "0.001"


def predicted_by_brute_force(spark, rows):
    """``(doc_id, score, label)``: each half by naive Bayes counted in one array over the other half."""
    from gleaner.functions.text import hash_unit
    from gleaner.operators.classify import train_language_model

    first = {r["doc_id"] for r in rows.filter(hash_unit("half", "doc_id") < 0.5).collect()}
    all_rows = rows.collect()
    for half in (True, False):
        known = [r for r in all_rows if (r["doc_id"] in first) != half]
        model = train_language_model(spark.createDataFrame(known, rows.schema))
        rest = [r for r in all_rows if (r["doc_id"] in first) == half]
        yield from zip(rest, *model.best([r["text"] or "" for r in rest]), [model] * len(rest))


def test_every_document_gets_a_language(spark):
    path = f"/root/testdata/sf{SF}"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    found = list(predicted_by_brute_force(spark, rows))
    want = {r["doc_id"]: label.upper() for r, _, label, _ in found}
    got = {r["doc_id"]: r["language"] for r in QUERIES["identify_language"](spark, path).collect()}
    assert got == want and len(got) == rows.count()

    sure = {r["doc_id"]: label.upper() for r, score, label, _ in found if score >= MIN_LANGUAGE_SCORE}
    short = {r["doc_id"] for r, *_ in found if len(r["text"] or "") < 40}
    out = QUERIES["drop_unsure_language"](spark, path).collect()
    assert {r["doc_id"]: r["language"] for r in out if not r["foreign"]} == sure and short
    as_foreign = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
    odd = {
        r["doc_id"]: best[1][0].upper()
        for r, _, _, model in found
        if (best := model.best([re.sub("[^а-я]", "я", (r["text"] or "").lower().translate(as_foreign))]))[0][0] >= MIN_LANGUAGE_SCORE
    }
    assert {r["doc_id"]: r["language"] for r in out if r["foreign"]} == odd


def test_every_document_gets_a_domain(spark):
    path = f"/root/testdata/sf{SF}"
    ids = {r["doc_id"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert {r["doc_id"] for r in QUERIES["classify_domain"](spark, path).collect()} == ids
