"""Prompt and answer files: prepare, combine, check, look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.modify import chat_turns, user_turn
from gleaner.functions.tokenize import Tokenizer
from gleaner.operators import sft
from gleaner.operators.ordinals import read_with_position, row_at
from gleaner.operators.sampling import pick_among_first, split_train_validation
from gleaner.sources.readers import FILE_NAME, read_documents, require_columns
from gleaner.sources.writers import write_documents


def _pairs(df: DataFrame, prompt_col: str, label_col: str, *more: str) -> DataFrame:
    return df.select(F.col(prompt_col).alias("prompt"), F.col(label_col).alias("label"), *more)


def prepare_jsonl(
    spark: SparkSession,
    input_glob: str,
    output_dir: str,
    prompt_col: str = "prompt",
    label_col: str = "label",
    val_ratio: float = 0.02,
    seed: int = 42,
) -> DataFrame:
    """Write cleaned rows as JSON lines under ``split=train`` and ``split=validation``; returns rows per split.

    A row's split follows from its file's name and its place in it, so it needs no id; one pass writes both sides and
    counts them.
    """
    require_columns(spark, input_glob, [prompt_col, label_col])
    place = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = _pairs(spark.read.parquet(input_glob), prompt_col, label_col, *place)
    split = split_train_validation(sft.clean_pairs(rows), val_ratio, ["_file", "_row"], seed)
    counts = Observation("split")
    sides = ("train", "validation")
    counted = split.select("prompt", "label", "split").observe(counts, *(F.count_if(F.col("split") == s).alias(s) for s in sides))
    counted.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(output_dir)
    return spark.createDataFrame([(s, counts.get[s]) for s in sides if counts.get[s]], "split string, n_rows bigint")


def combine_jsonl(
    spark: SparkSession, input_glob: str, output_dir: str, prompt_col: str = "prompt", label_col: str = "label"
) -> None:
    """Write ``prompt + line break + label`` as ``text``, one folder per input file."""
    require_columns(spark, input_glob, [prompt_col, label_col])
    rows = read_documents(spark, input_glob, columns=[prompt_col, label_col], add_filename=True)
    text = rows.select(sft.combined_text(F.col(prompt_col), F.col(label_col)).alias("text"), FILE_NAME)
    write_documents(text, output_dir, write_to_filename=True)


def validate(
    spark: SparkSession,
    input_glob: str,
    tokenizer: Tokenizer | None = None,
    prompt_col: str = "prompt",
    label_col: str = "label",
    seq_length: int = 4096,
) -> DataFrame:
    """The report over all rows of all files."""
    require_columns(spark, input_glob, [prompt_col, label_col])
    rows = read_documents(spark, input_glob, columns=[prompt_col, label_col])
    return sft.validation_report(_pairs(rows, prompt_col, label_col), seq_length, tokenizer)


def sample_check(
    spark: SparkSession, input_glob: str, num_samples: int = 20, prompt_col: str = "prompt", label_col: str = "label", seed: int = 42
) -> DataFrame:
    """One valid row at random among the first ``num_samples``, with its chat text; no row if none is valid."""
    rows = sft.clean_pairs(_pairs(read_with_position(spark, input_glob, "place"), prompt_col, label_col, "place"))
    picked = pick_among_first(rows, num_samples, "place", seed)
    return picked.withColumns(
        {"user_part": user_turn(F.col("prompt")), "full_text": chat_turns(F.col("prompt"), F.col("label"))}
    )


def show_row(
    spark: SparkSession, input_glob: str, index: int = 0, prompt_col: str = "prompt", label_col: str = "label"
) -> DataFrame:
    """The row at a global index with its combined text."""
    row = _pairs(row_at(spark, input_glob, index), prompt_col, label_col, "ordinal")
    return row.withColumn("text", sft.combined_text(F.col("prompt"), F.col("label")))
