"""Prompt and answer data: pairs, checks, chat text, tokens, loss mask, length and padding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.modify import chat_turns, user_turn
from gleaner.functions.text import compute_once, is_blank, strip
from gleaner.functions.tokenize import Tokenizer, hashed_tokens

IGNORED = -100


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns, such as ``question`` to ``prompt``."""
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return df.withColumnsRenamed(dict(mapping))


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, prompt, label)`` for each user turn answered by the next turn.

    Joined on conversation and turn number, so that one very long conversation is still many keys.
    """
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("label")
    )
    return user.join(answer, ["conv_id", "turn"])


def clean_pairs(df: DataFrame, prompt: str = "prompt", label: str = "label") -> DataFrame:
    """Nulls as empty, both sides stripped, rows with an empty side dropped."""
    tidy = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in (prompt, label)}
    return df.withColumns(tidy).filter((F.col(prompt) != "") & (F.col(label) != ""))


def combined_text(prompt: Column, label: Column) -> Column:
    """Prompt, line break, answer: text for plain next-token training."""
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit("\n"), F.coalesce(label, F.lit("")))


def loss_mask(user_ids: Column, full_ids: Column) -> Column:
    """The full ids with the prompt's part ignored; an error if the prompt is longer than the whole."""
    masked = F.concat(
        F.array_repeat(F.lit(IGNORED), F.size(user_ids)),
        F.slice(full_ids, F.size(user_ids) + 1, F.greatest(F.size(full_ids) - F.size(user_ids), F.lit(0))),
    )
    wrong = F.size(masked) != F.size(full_ids)
    return F.when(wrong, F.raise_error(F.lit("label mask length mismatch"))).otherwise(masked)


def tokenize_pairs(
    df: DataFrame, tokenizer: Tokenizer | None = None, prompt: str = "prompt", label: str = "label"
) -> DataFrame:
    """Add ``user_ids``, ``input_ids`` and ``labels`` from the chat text of each pair."""
    tokenizer = tokenizer or hashed_tokens()
    texts = compute_once(
        df, _user=user_turn(F.col(prompt)), _full=chat_turns(F.col(prompt), F.col(label))
    )
    ids = compute_once(texts, user_ids=tokenizer(F.col("_user")), input_ids=tokenizer(F.col("_full")))
    return ids.withColumn("labels", loss_mask(F.col("user_ids"), F.col("input_ids"))).drop("_user", "_full")


def prompt_is_prefix() -> Column:
    """Whether the prompt's ids begin the full ids, on which the mask relies."""
    return F.slice(F.col("input_ids"), 1, F.size("user_ids")) == F.col("user_ids")


def over_length(ids: Column, seq_length: int) -> Column:
    return F.size(ids) > seq_length


def truncate(ids: Column, seq_length: int) -> Column:
    return F.slice(ids, 1, seq_length)


def pad_to(ids: Column, length: Column | int, value: int) -> Column:
    """Fill up on the right; a longer array stays as it is."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def pad_batches(df: DataFrame, ordinal: str, batch_size: int, pad_id: int = 0) -> DataFrame:
    """Pad ``input_ids`` and ``labels`` to the longest row of each run of ``batch_size`` rows; adds ``batch``."""
    batched = df.withColumn("batch", F.floor(F.col(ordinal) / batch_size))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))  # batch_size rows at most
    return (
        batched.withColumn("_longest", longest)
        .withColumn("input_ids", pad_to(F.col("input_ids"), F.col("_longest"), pad_id))
        .withColumn("labels", pad_to(F.col("labels"), F.col("_longest"), IGNORED))
        .drop("_longest")
    )


def validation_report(
    df: DataFrame,
    seq_length: int = 4096,
    tokenizer: Tokenizer | None = None,
    prompt: str = "prompt",
    label: str = "label",
) -> DataFrame:
    """One row of counts over all pairs: total, valid, empty prompts, empty labels, over length and its percentage."""
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in (prompt, label)}
    no_prompt = is_blank(F.col(prompt))
    no_label = ~no_prompt & is_blank(F.col(label))
    state = df.select(*[t.alias(c) for c, t in texts.items()]).withColumns(
        {"_no_prompt": no_prompt, "_no_label": no_label}
    )
    tokens = tokenize_pairs(state, tokenizer, prompt, label)
    valid = ~F.col("_no_prompt") & ~F.col("_no_label")
    count = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    sums = tokens.agg(
        F.count("*").alias("total_rows"),
        count(valid).alias("checked_rows"),
        count("_no_prompt").alias("empty_prompts"),
        count("_no_label").alias("empty_labels"),
        # The mask is part of the check: an impossible one is an error.
        count(valid & over_length(F.col("labels"), seq_length)).alias("over_length"),
    )
    share = F.try_divide(F.col("over_length") * 100.0, F.col("total_rows"))
    return sums.withColumn("over_length_percent", share)
