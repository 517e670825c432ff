"""Whole curation plans, made of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.modify import reformat_unicode, unify_quotes_and_tags
from gleaner.functions.pii import pii_redactor
from gleaner.operators import filters
from gleaner.operators.compose import Modify, ScoreFilter, Sequential, skip_if_exists
from gleaner.operators.dedup import remove_exact_duplicates
from gleaner.operators.ordinals import add_id_by_position
from gleaner.plans.stages import Stage, run_stages
from gleaner.session import materialize
from gleaner.sources.readers import deal_out

HEURISTICS = str(Path(__file__).parent.parent / "config" / "heuristic_filter_non_en.yaml")


def clean_and_unify(df: DataFrame) -> DataFrame:
    return Sequential([Modify(unify_quotes_and_tags), Modify(reformat_unicode)])(df)


def filter_documents(df: DataFrame) -> DataFrame:
    """At least 80 words (kept as ``word_count``), a finished last sentence, little repetition."""
    rest = filters.FilterCascade(
        [
            filters.complete_document(),
            filters.top_ngram(2, 0.2),
            filters.top_ngram(3, 0.18),
            filters.top_ngram(4, 0.16),
        ]
    )
    return Sequential([ScoreFilter(filters.word_count(min_words=80), score_field="word_count"), rest])(df)


def redact_persons(df: DataFrame) -> DataFrame:
    return Modify(pii_redactor(["PERSON"]))(df)


def curate_web_corpus(df: DataFrame) -> DataFrame:
    """Clean, filter, redact: one stage, no shuffle."""
    return Sequential([clean_and_unify, filter_documents, redact_persons])(df)


def heuristic_filter(df: DataFrame, config: str = HEURISTICS) -> DataFrame:
    """At least ten words, then the configured cascade."""
    cascade = filters.build_filter_cascade(config)
    minimum = filters.word_count(min_words=10, max_words=1_000_000_000)
    return filters.FilterCascade([minimum, *cascade.filters], cascade.text_field)(df)


def curate_pretraining_corpus(
    spark: SparkSession,
    paths: str | Sequence[str],
    id_prefix: str,
    stage_dir: str | None = None,
    config: str = HEURISTICS,
    partitions: int | None = None,
) -> DataFrame:
    """Number, reformat, remove exact copies, apply the quality heuristics to a parquet corpus.

    Ids come from the place in the files, so numbering moves no text.  The reformatted corpus is written once, as
    both the hashing and the filtering read it; with ``stage_dir`` a rerun goes on from what is there.
    """
    numbered = add_id_by_position(spark, paths, "id", id_prefix)
    if partitions:
        numbered = deal_out(numbered, partitions)
    formatted = Modify(reformat_unicode)(numbered)
    if stage_dir:
        fresh = formatted
        formatted = skip_if_exists(f"{stage_dir}/formatted", lambda: fresh, spark)
    else:
        formatted = materialize(formatted, "formatted")
    return heuristic_filter(remove_exact_duplicates(formatted), config)


def documents_per_language(df: DataFrame) -> DataFrame:
    """Filter by length and ending, drop exact copies, count per language."""
    kept = Sequential(
        [
            filters.FilterCascade([filters.word_count(min_words=80), filters.complete_document()]),
            lambda d: remove_exact_duplicates(d, "doc_id"),
        ]
    )(df)
    return kept.groupBy("lang").agg(F.count("*").alias("n_documents"))


def documents_per_language_in_stages(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """The same in written stages: a killed run goes on after the last one written, and each text is stored once at a time."""
    finished = filters.FilterCascade([filters.word_count(min_words=80), filters.complete_document()])
    stages = [
        Stage("finished", finished, ("documents",)),
        Stage("unique", lambda d: remove_exact_duplicates(d, "doc_id"), ("finished",)),
        Stage("per_language", lambda d: d.groupBy("lang").agg(F.count("*").alias("n_documents")), ("unique",)),
    ]
    return run_stages(spark, {"documents": df}, stages, folder)
