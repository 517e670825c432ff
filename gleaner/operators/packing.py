"""Token corpus, fixed-length samples over document borders, and step counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.tokenize import Tokenizer, hashed_tokens
from gleaner.operators.ordinals import with_ordinal
from gleaner.session import materialize


def tokenize_corpus(
    df: DataFrame,
    id_field: str = "id",
    text_field: str = "text",
    tokenizer: Tokenizer | None = None,
    end_of_document: int | None = None,
) -> DataFrame:
    """``(id, tokens, n_tokens)`` with the end-of-document token appended if one is named."""
    tokens = (tokenizer or hashed_tokens())(F.coalesce(F.col(text_field), F.lit("")))
    if end_of_document is not None:
        tokens = F.array_append(tokens, F.lit(end_of_document))
    return df.select(id_field, tokens.alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def token_offsets(tokenised: DataFrame, id_field: str = "id") -> DataFrame:
    """``(id, n_tokens, start)``: where each document begins in the stream of all tokens in id order."""
    return with_ordinal(tokenised.select(id_field, "n_tokens"), id_field, "_ordinal", {"start": "n_tokens"}).drop("_ordinal")


def sample_pieces(offsets: DataFrame, seq_length: int) -> DataFrame:
    """One row per document and sample it reaches into: ``sample``, ``begin`` in the document, ``length``."""
    spread = F.sequence(F.expr(f"CAST(start AS BIGINT) div {seq_length}"), F.expr(f"(CAST(start AS BIGINT) + n_tokens - 1) div {seq_length}"))
    pieces = offsets.filter(F.col("n_tokens") > 0).withColumn("sample", F.explode(spread))
    low = F.greatest(F.col("start"), F.col("sample") * seq_length)
    high = F.least(F.col("start") + F.col("n_tokens"), (F.col("sample") + 1) * seq_length)
    return pieces.withColumn("begin", (low - F.col("start")).cast("int")).withColumn("length", (high - low).cast("int"))


def sample_lengths(offsets: DataFrame, seq_length: int) -> DataFrame:
    """``(sample, n_documents, n_tokens)``; only the last sample may be short."""
    return sample_pieces(offsets, seq_length).groupBy("sample").agg(
        F.count("*").alias("n_documents"), F.sum("length").alias("n_tokens")
    )


def pack_samples(tokenised: DataFrame, seq_length: int, id_field: str = "id", drop_last: bool = False) -> DataFrame:
    """``(sample, tokens)``: the stream of all documents in id order, cut into samples of ``seq_length``.

    A sample gathers at most ``seq_length`` tokens, so no group grows with the data.
    """
    tokenised = materialize(tokenised, "tokens")
    offsets = token_offsets(tokenised, id_field)
    rows = tokenised.select(id_field, "tokens").join(offsets, id_field).filter("n_tokens > 0")
    first, last = (F.expr(f"(CAST(start AS BIGINT) + {x}) div {seq_length}") for x in ("0", "n_tokens - 1"))

    def part(sample: Column) -> Column:
        low = F.greatest(F.col("start"), sample * seq_length) - F.col("start")
        high = F.least(F.col("start") + F.col("n_tokens"), (sample + 1) * seq_length) - F.col("start")
        tokens = F.slice("tokens", (low + 1).cast("int"), (high - low).cast("int"))
        return F.struct(sample.alias("sample"), F.struct(F.col("start"), tokens.alias("part")).alias("piece"))

    # The slices are made before the rows multiply, so that no row carries the whole document along.
    pieces = rows.select(F.transform(F.sequence(first, last), part).alias("_parts")).select(F.inline("_parts"))
    samples = pieces.groupBy("sample").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["part"])).alias("tokens")
    )
    return samples.filter(F.size("tokens") == seq_length) if drop_last else samples


def token_budget(
    tokenised: DataFrame, global_batch_size: int, seq_length: int, rounding: str = "ceil"
) -> DataFrame:
    """One row: tokens, documents, tokens per step, steps per epoch by tokens and by documents."""
    if rounding not in ("ceil", "floor"):
        raise ValueError("rounding is ceil or floor")
    round_ = F.ceil if rounding == "ceil" else F.floor
    per_step = global_batch_size * seq_length
    sums = tokenised.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return sums.select(
        "n_documents",
        "n_tokens",
        F.lit(per_step).cast("bigint").alias("tokens_per_step"),
        round_(F.col("n_tokens") / per_step).alias("steps_by_tokens"),
        round_(F.col("n_documents") / global_batch_size).alias("steps_by_documents"),
    )
