"""Samples, shuffles, slices and splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gleaner.functions.text import hash_order, hash_unit
from gleaner.operators.ordinals import OrderedKeys


#: Up to here the first keys are found by an ordered limit; a longer list of keys is never brought together.
FEW = 100_000
#: Hexadecimal digits of the hash by which a histogram is refined: 65,536 bins, whatever n and the number of rows.
DIGITS = 4


def head(df: DataFrame, n: int, order_by: str) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def first_n(df: DataFrame, n: int, order_by: str | Sequence[str]) -> DataFrame:
    """The first n rows in key order; the key must be unique.

    The rows are filtered in place by the n-th key.  Beyond ``FEW`` it is looked up among the ordered keys.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    key = F.struct(*keys)
    if n <= FEW:
        return df.filter(key <= df.select(key.alias("_key")).orderBy("_key").limit(n).agg(F.max("_key")).scalar())
    ordered = OrderedKeys(df, keys)
    return df if n >= ordered.total else df.filter(ordered.key <= ordered.at(n - 1))


def _bin_of_nth(bins: DataFrame, n: int) -> Row | None:
    """The first row of ``bins`` (order, n_rows) up to which there are n rows, with those ``before`` it."""
    upto = F.sum("n_rows").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    reached = bins.withColumn("upto", upto).filter(F.col("upto") >= n)
    return reached.select("order", (F.col("upto") - F.col("n_rows")).alias("before")).orderBy("order").first()


def sample_exactly(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows at random, the same for a seed whatever the partitioning; all rows when there are no more than n.

    Two histograms of the keys' hashes, the second inside the bin of the first that holds the n-th, leave one row in 2^32
    to be ordered, so n may be anything.  The key must be unique: rows of the n-th key stay or go together.
    """
    order = hash_order(seed, key)
    hashed = df.select(order.alias("hash"), F.col(key).alias("key"))
    if n < 1:
        return df.filter(F.lit(False))
    start, left = "", n
    for digits in (DIGITS, 2 * DIGITS):
        inside = hashed.filter(F.col("hash").startswith(start))
        held = _bin_of_nth(inside.groupBy(F.left("hash", F.lit(digits)).alias("order")).agg(F.count("*").alias("n_rows")), left)
        if held is None:
            return df
        start, left = held["order"], left - held["before"]
    inside = hashed.filter(F.col("hash").startswith(start))
    last = _bin_of_nth(inside.groupBy(F.struct("hash", "key").alias("order")).agg(F.count("*").alias("n_rows")), left)["order"]
    # The key is only looked at where two keys share the n-th hash.
    return df.filter((order < last["hash"]) | ((order == last["hash"]) & F.coalesce(F.col(key) <= F.lit(last["key"]), F.lit(True))))


def sample_about(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """About n rows: each row by itself with probability n over the row count."""
    total = df.agg(F.count("*")).scalar()
    return df.filter(hash_unit(seed, key) * total < F.lit(n))


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible random order."""
    return df.orderBy(hash_order(seed, key), key)


def pick_among_first(df: DataFrame, n: int, order_by: str, seed: int = 42) -> DataFrame:
    """One row at random among the first n."""
    return first_n(df, n, order_by).orderBy(hash_order(seed, order_by), order_by).limit(1)


def split_train_validation(df: DataFrame, val_ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``split``; each row goes to validation by itself with probability ``val_ratio``."""
    if not 0.0 < val_ratio < 1.0:
        raise ValueError("val_ratio must be in (0, 1)")
    chosen = hash_unit(seed, *keys) < F.lit(val_ratio)
    return df.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def duplicate_samples(df: DataFrame) -> DataFrame:
    """Every row twice: the known-answer corpus for deduplication."""
    return df.unionAll(df)


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """All rows of all corpora, reduced to their text."""
    out = corpora[0].select("text")
    for corpus in corpora[1:]:
        out = out.unionByName(corpus.select("text"))
    return out
