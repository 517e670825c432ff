"""Exact duplicates: which ids share a text, which of them go, and the corpus without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import materialize

HASH = "_hashes"


def _prints(df: DataFrame, id_field: str, text_field: str, hash_method: str, cache_dir: str | None) -> DataFrame:
    """``(id, _hashes)`` per document, written once: the text is read and hashed a single time."""
    if hash_method != "md5":
        raise ValueError("md5 is the only hash method")
    # A null text is no copy of another.
    prints = df.filter(F.col(text_field).isNotNull()).select(id_field, F.md5(text_field).alias(HASH))
    return materialize(prints, "prints", f"{cache_dir}/prints" if cache_dir else None)


def beyond_first(df: DataFrame, key: str, id_field: str, rows_per_salt: int | None = None) -> DataFrame:
    """Rows that are not the first of their key, the first being the one with the smallest id.

    The smallest id and the count per key are combined on the map side, so a key with a third of all rows costs
    one row per task, and the join back spreads such a key.  Reads ``df`` twice; give it a written table.
    """
    firsts = df.groupBy(key).agg(F.min(id_field).alias("_first"), F.count("*").alias("n")).filter("n > 1")
    joined = join_by_heavy_key(df, firsts, key, firsts, rows_per_salt=rows_per_salt)
    return joined.filter(F.col(id_field) != F.col("_first")).select(*df.columns)


def exact_duplicates(
    df: DataFrame,
    id_field: str = "id",
    text_field: str = "text",
    hash_method: str = "md5",
    cache_dir: str | None = None,
    rows_per_salt: int | None = None,
) -> DataFrame:
    """``(id, _hashes)`` of every document whose text occurs more than once."""
    prints = _prints(df, id_field, text_field, hash_method, cache_dir)
    groups = prints.groupBy(HASH).agg(F.count("*").alias("n")).filter("n > 1")
    found = join_by_heavy_key(prints, groups, HASH, groups, rows_per_salt=rows_per_salt).select(id_field, HASH)
    return materialize(found, "exact", f"{cache_dir}/_exact_duplicates.parquet") if cache_dir else found


def exact_duplicates_to_remove(
    df: DataFrame, id_field: str = "id", text_field: str = "text", hash_method: str = "md5",
    cache_dir: str | None = None, rows_per_salt: int | None = None,
) -> DataFrame:
    """``(id, _hashes)`` of all copies but the first."""
    prints = _prints(df, id_field, text_field, hash_method, cache_dir)
    return beyond_first(prints, HASH, id_field, rows_per_salt)


def remove_ids(df: DataFrame, ids: DataFrame, id_field: str = "id") -> DataFrame:
    """Rows whose id is not listed.  The list stays distributed; it is broadcast only if the planner finds it small."""
    return df.join(ids.select(id_field), id_field, "left_anti")


def remove_exact_duplicates(df: DataFrame, id_field: str = "id", text_field: str = "text") -> DataFrame:
    """Keep the first copy of every text."""
    return remove_ids(df, exact_duplicates_to_remove(df, id_field, text_field), id_field)
