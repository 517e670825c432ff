"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

quality rules (texts that they reject go), line dedup, near dedup (one document of each group stays), benchmark
decontamination, best-fit packing.  Each stage judges what its predecessor kept.  All but the last return the columns of
``documents``; ``n_chars``, where there is one, is counted anew when lines have gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bbit import drop_near_duplicates
from gleaner.llm.bestfit import pack_best_fit, token_pieces
from gleaner.llm.linededup import drop_repeated_lines
from gleaner.llm.quality import keep_good, train_quality
from gleaner.llm.queries import default_tokenizer, table
from gleaner.llm.wumanber import drop_contaminated
from gleaner.session import discard, materialize, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, as they are; repeated rows share a verdict.

    A null or empty text has no words and goes.  The classifier learns from those of ``docs`` that ``labels`` marks.
    """
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that three or more documents hold, except in the largest ``doc_id``.

    A null text stays null, a row without an id keeps its lines, rows of one id are one document.  ``n_chars`` is counted anew.
    """
    kept = drop_repeated_lines(docs, min_chars=20, min_docs=3)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest ``doc_id``, of each group of near duplicates.

    Rows of one id stay or go together; rows without an id or without words stay.
    """
    return drop_near_duplicates(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words lies in benchmark windows.  A null text has none and stays."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence.  A null text is empty: one piece of the end token."""
    pieces = token_pieces(docs, default_tokenizer(), capacity=4096, keep_ids=False).drop("ids")
    return pack_best_fit(pieces, capacity=4096, order=["doc_id", "piece"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained model and a tokenizer take part; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one has been written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, scratch_path(spark, f"pipeline-{name}")
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", path)
        if before is not None:
            discard(spark, before)
    return docs
