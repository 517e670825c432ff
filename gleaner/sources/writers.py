"""Writers: JSON lines, parquet and text, by source file, by field value, or in shards.

None of them brings rows to the driver.  ``compact`` adds a rebalancing shuffle, which joins the many small files
of a partitioned write and splits a value that holds much of the data over several files.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import chain, count
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import discard, exists, file_system, touch
from gleaner.sources.readers import FILE_NAME

# What a data file's name may end in; the written file's own ending takes its place.
ENDINGS = {".json", ".jsonl", ".parquet", ".txt", ".csv", ".gz", ".zst", ".bz2"}


def _write(df: DataFrame, path: str, file_type: str, by: str | None, compact: bool, mode: str) -> None:
    if by:
        # The folder carries the value and the payload loses the column, so a copy names the folder.
        df = df.withColumn(f"by_{by}", F.col(by))
        if compact:
            df = df.hint("rebalance", f"by_{by}")
    writer = df.write.mode(mode)
    if file_type == "json":
        writer = writer.option("ignoreNullFields", "false")
    if by:
        writer = writer.partitionBy(f"by_{by}")
    writer.format(file_type).save(path)


def write_documents(
    df: DataFrame,
    path: str,
    file_type: str = "json",
    write_to_filename: bool = False,
    compact: bool = False,
    mode: str = "overwrite",
) -> None:
    """Write numbered parts, or with ``write_to_filename`` a file per source file, under the source file's name.

    The rows of a source are brought together by a rebalancing shuffle, which also splits a source that holds much of the data:
    ``a.json`` then comes as ``a-00000.json``, ``a-00001.json`` and so on.  The name's ending follows what is written.  Rows
    without a name go to ``unnamed``; sources whose names differ in their endings only become parts of one.
    """
    if not write_to_filename:
        return _write(df, path, file_type, None, compact, mode)
    spark = df.sparkSession
    if mode in ("ignore", "error", "errorifexists") and exists(spark, path):
        if mode == "ignore":
            return None
        raise FileExistsError(path)
    # The plan has run to its end before anything in the folder changes, so it may read from there.
    staging = f"{path}/_writing-{uuid.uuid4().hex}"
    _write(df, staging, file_type, FILE_NAME, True, "error")
    _name_after_sources(spark, staging, path, file_type, mode)


def _files(spark, folder: str) -> list[tuple[str, str]]:
    system, target = file_system(spark, folder)
    return sorted((f.getPath().getName(), f.getPath().toString()) for f in system.listStatus(target))


def _name_after_sources(spark, staging: str, path: str, file_type: str, mode: str) -> None:
    """Move the parts of each source's folder to names of their own.  The driver sees names only, one per written file."""
    parts = defaultdict(list)
    for folder, where in _files(spark, staging):
        if folder.startswith(f"by_{FILE_NAME}="):
            name = PurePosixPath(unquote(folder.partition("=")[2]).replace("/", "_"))
            while name.suffix in ENDINGS:
                name = name.with_suffix("")
            stem = "unnamed" if name.name == "__HIVE_DEFAULT_PARTITION__" else name.name
            parts[stem] += [part for file, part in _files(spark, where) if not file.startswith(("_", "."))]
    taken = set()
    for name, where in _files(spark, path):
        if mode == "append":
            taken.add(name)
        elif not where.endswith(PurePosixPath(staging).name):
            discard(spark, where)
    for stem, files in parts.items():
        names = (f"{stem}-{k:05d}.{file_type}" for k in count())
        names = chain([f"{stem}.{file_type}"], names) if len(files) == 1 else names
        for part, name in zip(files, (n for n in names if n not in taken)):
            taken.add(name)
            system, target = file_system(spark, f"{path}/{name}")
            if not system.rename(file_system(spark, part)[1], target):
                raise OSError(f"cannot move {part} to {target}")
    discard(spark, staging)
    touch(spark, f"{path}/_SUCCESS")


def separate_by_field(
    df: DataFrame, path: str, field: str, file_type: str = "json", compact: bool = False, mode: str = "overwrite"
) -> DataFrame:
    """Write a sub-folder per value of ``field`` and return the rows per value in the folder.

    They are counted from what was written, without a column of it: ``df`` runs once.  With ``mode="append"`` earlier rows
    count too.  A null and an empty value share a folder, and count as null.
    """
    _write(df, path, file_type, field, compact, mode)
    stored = df.schema.add(f"by_{field}", df.schema[field].dataType)
    written = df.sparkSession.read.schema(stored).format(file_type).load(path)
    return written.groupBy(F.col(f"by_{field}").alias(field)).agg(F.count("*").alias("n_documents"))


def write_shards(df: DataFrame, path: str, num_shards: int, order_by: str | None = None, mode: str = "overwrite") -> None:
    """Write exactly ``num_shards`` parquet files, even in size, or in key order."""
    sharded = df.repartitionByRange(num_shards, order_by) if order_by else df.repartition(num_shards)
    sharded.write.mode(mode).parquet(path)


def write_lines(df: DataFrame, path: str, field: str = "text", mode: str = "overwrite") -> None:
    """Write one line per row of a string column.  Line breaks inside would split a sample, so they must be gone."""
    checked = F.when(
        F.col(field).rlike("[\r\n]"), F.raise_error(F.lit("a line break inside a one-line sample"))
    ).otherwise(F.col(field))
    df.select(checked.cast("string").alias("value")).write.mode(mode).text(path)
