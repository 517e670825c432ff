"""Sequential numbers, ids and running sums over a whole corpus without one task seeing all of it.

Rows are range partitioned and sorted, and each row is written with its partition and its place in it.  Row
counts per partition are a small table (one row per partition), whose running sum gives each partition's
offset.  Nothing but that table is ever ordered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import materialize, scratch_path

BROADCAST_FILES = 1_000_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place within the partition in its low 33 bits


def with_ordinal(
    df: DataFrame,
    order_by: str | Sequence[str],
    ordinal: str = "ordinal",
    running: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based place of each row in the order of ``order_by``, which must be unique.

    ``running`` maps a new column to a numeric column and gives the sum over all earlier rows.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    place = F.monotonically_increasing_id().bitwiseAND((1 << _LOCAL_BITS) - 1)
    placed = ranged.sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), place.alias("_place")
    )
    # The two reads below must see the same partitions, so they read what one run wrote.
    placed = materialize(placed, "ordinal")
    sums = {new: F.sum(F.coalesce(F.col(source), F.lit(0))) for new, source in (running or {}).items()}
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), *[s.alias(f"_sum_{n}") for n, s in sums.items()])
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
    )
    out = placed.join(F.broadcast(offsets), "_part")  # one row per partition
    if running:
        inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        for new, source in running.items():
            local = F.coalesce(F.sum(F.coalesce(F.col(source), F.lit(0))).over(inside), F.lit(0))
            out = out.withColumn(new, F.col(f"_start_{new}") + local)
    return out.select(*df.columns, (F.col("_offset") + F.col("_place")).alias(ordinal), *(running or {}))


def file_offsets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(_f1, _f2, _file, _rows, _offset)``: each file, named by 128 bits of hash, with the rows before it; a written table.

    Files in sorted order; only row counts are read, no column of the rows.
    """
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    counts = df.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offset = F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    return materialize(counts.select(*_file_name(F.col("_file")), "_file", "_rows", offset), "file-offsets")


def _file_name(path: Column) -> list[Column]:
    return [F.xxhash64(path).alias("_f1"), F.xxhash64(F.lit(1), path).alias("_f2")]


def read_with_position(spark: SparkSession, paths: str | Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Parquet rows with their 0-based place in (file, row) order, without sorting or shuffling any row.

    The place inside a file comes with the scan.  The offsets, 24 bytes a file, are broadcast when the count of the files
    shows that they are few enough; with more files the join is the planner's.
    """
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    offsets = file_offsets(spark, paths).select("_f1", "_f2", "_offset")
    if offsets.count() <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    placed = df.select("*", *_file_name(F.col("_metadata.file_path")), F.col("_metadata.row_index").alias("_row"))
    return placed.join(offsets, ["_f1", "_f2"]).select(*df.columns, (F.col("_offset") + F.col("_row")).alias(ordinal))


def id_of(ordinal: Column, prefix: str, start_index: int = 0) -> Column:
    """``prefix-0000000000``: ten digits, or more once the number needs them."""
    number = (ordinal + start_index).cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.when(F.length(number) >= 10, number).otherwise(F.lpad(number, 10, "0")))


def add_id(
    df: DataFrame,
    order_by: str | Sequence[str],
    id_field: str = "id",
    id_prefix: str = "doc_id",
    start_index: int = 0,
) -> DataFrame:
    """Number all rows in order and write the number as an id."""
    out = with_ordinal(df, order_by, "_ordinal")
    return out.withColumn(id_field, id_of(F.col("_ordinal"), id_prefix, start_index)).drop("_ordinal")


def add_id_by_position(
    spark: SparkSession,
    paths: str | Sequence[str],
    id_field: str = "id",
    id_prefix: str = "doc_id",
    start_index: int = 0,
) -> DataFrame:
    """Ids in stored order for a parquet corpus, in one pass and without a shuffle of the documents."""
    out = read_with_position(spark, paths, "_ordinal")
    return out.withColumn(id_field, id_of(F.col("_ordinal"), id_prefix, start_index)).drop("_ordinal")


def row_at(spark: SparkSession, paths: str | Sequence[str], index: int) -> DataFrame:
    """The row at a place in (file, row) order; an error when there are fewer rows."""
    offsets = file_offsets(spark, paths)
    holder = offsets.filter((F.col("_offset") <= index) & (F.col("_offset") + F.col("_rows") > index)).first()
    if index < 0 or holder is None:
        raise IndexError(f"index {index} out of range, {offsets.agg(F.sum('_rows')).first()[0] or 0} rows")
    # Only the file that holds the row is read.
    df = spark.read.parquet(holder["_file"])
    found = df.filter(F.col("_metadata.row_index") == index - holder["_offset"])
    return found.select(*df.columns, F.lit(index).cast("bigint").alias("ordinal"))


class OrderedKeys:
    """The keys of ``df`` alone in order, written once, with the rows before each range of them.

    For places far into the order: a key is looked up in its range, so no task ever holds more than a range, and no other
    column of ``df`` moves.  ``df`` must give the same keys when it is read again for the rows.
    """

    def __init__(self, df: DataFrame, order_by: str | Sequence[str]):
        self.keys = [order_by] if isinstance(order_by, str) else list(order_by)
        place = F.monotonically_increasing_id().bitwiseAND((1 << _LOCAL_BITS) - 1)
        ranged = df.select(*self.keys).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)
        self.path = scratch_path(df.sparkSession, "ordered-keys")
        key, part = F.struct(*self.keys).alias("_key"), F.spark_partition_id().alias("_part")
        self.placed = materialize(ranged.select(key, part, place.alias("_place")), "ordered-keys", self.path)
        counts = self.placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        self.offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        self.total = self.placed.count()

    @property
    def key(self) -> Column:
        """The key of a row of ``df``, to compare with ``at``."""
        return F.struct(*self.keys)

    def at(self, place: int) -> Column:
        """The key at a 0-based place, which must be below ``total``."""
        if not 0 <= place < self.total:
            raise IndexError(f"place {place} out of range, {self.total} rows")
        holder = self.offsets.filter((F.col("_offset") <= place) & (F.col("_offset") + F.col("_rows") > place)).first()
        found = (F.col("_part") == holder["_part"]) & (F.col("_place") == place - holder["_offset"])
        return self.placed.filter(found).select("_key").scalar()


def split_by_order(
    df: DataFrame, fractions: dict[str, float], order_by: str | Sequence[str], split: str = "split"
) -> DataFrame:
    """Contiguous split in key order by shares of the row count, such as 0.995, 0.005 and 0.

    Part k takes the places from the rounded-down end of part k-1 to its own; the last one takes the rest.  The key, which
    must be unique, is compared with the keys at those ends: no row moves.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-9 or any(f < 0 for f in fractions.values()):
        raise ValueError("shares must be non-negative and add up to 1")
    edges, reached = [], 0.0
    for name, share in fractions.items():
        reached += share
        edges.append((name, round(reached, 12)))
    last = [name for name, share in fractions.items() if share > 0][-1]
    ordered = OrderedKeys(df, order_by)
    named = F.lit(last)
    for name, edge in reversed(edges):
        if edge < 1.0 and ordered.total:
            named = F.when(ordered.key < ordered.at(math.floor(ordered.total * edge)), F.lit(name)).otherwise(named)
    return df.withColumn(split, named)
