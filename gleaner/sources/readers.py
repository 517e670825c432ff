"""Readers: JSON lines and parquet corpora, one row per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DOCUMENT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("url", T.StringType()),
    ]
)
FILE_NAME = "file_name"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    file_type: str = "parquet",
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    add_filename: bool = False,
    recursive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Read a folder, a glob or a list of files.

    JSON needs a ``schema``: inferring one would read the whole corpus twice.  ``columns`` reaches the parquet
    scan.  Split size decides the tasks; a file that cannot be split, such as gzipped JSON, is one.  ``partitions`` deals
    the rows out anew, a shuffle of all selected columns: give it only for input that is small or cannot be split.
    """
    if file_type == "json" and schema is None:
        raise ValueError("give the schema of JSON input")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema is not None:
        reader = reader.schema(schema)
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = reader.format(file_type).load(paths)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no input files match {paths}") from error
        raise
    if add_filename:
        df = df.select("*", F.col("_metadata.file_name").alias(FILE_NAME))
    if columns is not None:
        df = df.select(*columns, *([FILE_NAME] if add_filename else []))
    return deal_out(df, partitions) if partitions else df


def deal_out(df: DataFrame, partitions: int) -> DataFrame:
    """The rows over a given number of partitions; later filters stay above the shuffle, where all tasks share them."""
    return df.repartition(partitions).select(F.inline(F.array(F.struct("*"))))


def input_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Path and length of each input file, in sorted order; file contents are not read."""
    try:
        files = spark.read.format("binaryFile").load(paths).select("path", "length")
    except AnalysisException as error:
        raise FileNotFoundError(f"no input files match {paths}") from error
    return files.orderBy("path")


def open_store(path: str):
    """The pyarrow file system of a path and the path inside it; Spark's names of stores are translated."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    same = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gs": "gs"}
    return fs.FileSystem.from_uri(f"{same.get(scheme, scheme)}{mark}{rest}")


def missing_columns(
    spark: SparkSession, paths: str | Sequence[str], required: Sequence[str], store: Callable[[str], tuple] = open_store
) -> DataFrame:
    """Parquet files that lack a required column, with the columns each one lacks.

    A merged schema would hide a bad file, so each footer is looked at by itself, in tasks.  ``store`` opens a path; give
    your own for a file system that pyarrow does not know by its name.
    """
    required = list(required)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, name = store(path)
                names = pq.read_schema(name, filesystem=system).names
                rows.append((path, [c for c in required if c not in names]))
            yield pd.DataFrame(rows, columns=["path", "missing"])

    files = spark.read.format("binaryFile").load(paths).select("path")
    found = files.mapInPandas(check, "path string, missing array<string>")
    return found.filter(F.size("missing") > 0)


def require_columns(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str]) -> None:
    """Raise on the first few files that lack a required column."""
    bad = missing_columns(spark, paths, required).orderBy("path").take(5)
    if bad:
        raise ValueError("missing columns: " + "; ".join(f"{r.missing} in {r.path}" for r in bad))
