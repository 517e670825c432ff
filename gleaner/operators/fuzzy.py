"""Near duplicates: MinHash, LSH bands, star edges per bucket, components, keep the first of each group.

A bucket is never expanded into pairs and never gathered in one place.  Its smallest id is its centre, found by
a grouping that combines on the map side, and each other member gets one edge to the centre.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.minhash import minhash
from gleaner.operators.components import connected_components
from gleaner.operators.dedup import remove_ids
from gleaner.operators.similarity_join import confirmed_edges
from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import materialize


@dataclass(frozen=True)
class FuzzyConfig:
    """``bands_per_pass`` bounds the shuffle on disk: so many bands are shuffled at once, all by default.

    With ``false_positive_check`` an edge must also reach ``jaccard_threshold`` over the character n-grams, and all members
    of a bucket that do are joined, see ``similarity_join.py``.
    """

    id_field: str = "id"
    text_field: str = "text"
    seed: int = 42
    char_ngrams: int = 24
    num_buckets: int = 20
    hashes_per_bucket: int = 13
    bands_per_pass: int | None = None
    false_positive_check: bool = False
    jaccard_threshold: float = 0.8
    rows_per_salt: int | None = None


def signatures(df: DataFrame, config: FuzzyConfig) -> DataFrame:
    """``(id, signature)`` of every document with text."""
    sig = minhash(F.col(config.text_field), config.char_ngrams, config.num_buckets * config.hashes_per_bucket, config.seed)
    return df.filter(F.length(config.text_field) > 0).select(config.id_field, sig.alias("signature"))


def band_hashes(signature: Column, num_buckets: int, hashes_per_bucket: int) -> Column:
    """One bucket name per band: 120 bits of the md5 of the band's values, as two numbers."""

    def bucket(band: Column) -> Column:
        part = F.slice(signature, band * hashes_per_bucket + 1, hashes_per_bucket)
        name = F.md5(F.array_join(F.transform(part, lambda v: v.cast("string")), " "))
        return F.struct(*[F.conv(F.substring(name, at, 15), 16, 10).cast("bigint").alias(h) for at, h in ((1, "h1"), (16, "h2"))])

    return F.transform(F.sequence(F.lit(0), F.lit(num_buckets - 1)), bucket)


def lsh_buckets(sigs: DataFrame, config: FuzzyConfig) -> DataFrame:
    """``(id, band, h1, h2)``, one row per document and band."""
    bands = band_hashes(F.col("signature"), config.num_buckets, config.hashes_per_bucket)
    rows = sigs.select(config.id_field, F.posexplode(bands).alias("band", "bucket"))
    return rows.select(config.id_field, "band", "bucket.h1", "bucket.h2")


def bucket_edges(
    buckets: DataFrame, id_field: str, rows_per_salt: int | None = None, key: Sequence[str] = ("band", "h1", "h2")
) -> DataFrame:
    """Edges ``(src, dst, *key)`` from each member of a shared bucket to the smallest id in it."""
    key = list(key)
    centres = buckets.groupBy(*key).agg(F.min(id_field).alias("dst"), F.count("*").alias("n")).filter("n > 1")
    centres = materialize(centres, "centres")  # read for the heavy ones and for the join
    joined = join_by_heavy_key(buckets, centres, key, centres, rows_per_salt=rows_per_salt)
    return joined.filter(F.col(id_field) != F.col("dst")).select(F.col(id_field).alias("src"), "dst", *key)


def _shingles(text: str, width: int) -> set[str]:
    """Distinct character n-grams; a shorter text is its own single one."""
    return {text[i : i + width] for i in range(max(len(text) - width + 1, 1))}


def jaccard(a: Column, b: Column, width: int) -> Column:
    """Exact Jaccard similarity of two texts over their character n-grams."""

    # Not a column expression: taking substrings one by one costs the square of the length.
    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        scores = []
        for x, y in zip(left, right):
            x, y = _shingles(x, width), _shingles(y, width)
            common = len(x & y)
            scores.append(common / (len(x) + len(y) - common))
        return pd.Series(scores, dtype=float)

    return similarity.asNondeterministic()(a, b)


def edge_similarity(edges: DataFrame, df: DataFrame, config: FuzzyConfig) -> DataFrame:
    """Distinct ``(src, dst)`` with their exact similarity.  A centre with many edges is spread over tasks."""
    pairs = edges.select("src", "dst").distinct()
    ends = df.select(config.id_field, config.text_field)
    src = ends.toDF("src", "_src_text")
    dst = ends.toDF("dst", "_dst_text")
    weights = pairs.groupBy("dst").agg(F.count("*").alias("n"))
    src_weights = pairs.groupBy("src").agg(F.count("*").alias("n"))
    # The centre's text first, while the rows are still narrow.
    with_dst = join_by_heavy_key(pairs, dst, "dst", weights, rows_per_salt=config.rows_per_salt)
    both = join_by_heavy_key(with_dst, src, "src", src_weights, rows_per_salt=config.rows_per_salt)
    similarity = jaccard(F.col("_src_text"), F.col("_dst_text"), config.char_ngrams)
    return both.select("src", "dst", similarity.alias("similarity"))


def _confirmed_edges(buckets: DataFrame, df: DataFrame, config: FuzzyConfig) -> DataFrame:
    """Edges between members of a bucket that pass the similarity check, enough to join all that do."""
    return confirmed_edges(
        buckets, df, config.id_field, config.text_field, config.char_ngrams, config.jaccard_threshold, rows_per_salt=config.rows_per_salt
    )


def fuzzy_edges(df: DataFrame, config: FuzzyConfig) -> DataFrame:
    """Candidate edges ``(src, dst)`` over all bands, or confirmed ones with the check switched on."""
    sigs = signatures(df, config)
    bands = band_hashes(F.col("signature"), config.num_buckets, config.hashes_per_bucket)
    # The costly signatures are computed once and kept as narrow bucket names.
    named = materialize(sigs.select(config.id_field, bands.alias("buckets")), "bands")
    step = config.bands_per_pass or config.num_buckets
    found = []
    for start in range(0, config.num_buckets, step):
        part = F.slice("buckets", start + 1, step)
        rows = named.select(config.id_field, F.posexplode(part).alias("band", "bucket"))
        rows = rows.select(config.id_field, (F.col("band") + start).alias("band"), "bucket.h1", "bucket.h2")
        if config.false_positive_check:
            edges = _confirmed_edges(rows, df, config)
        else:
            edges = bucket_edges(rows, config.id_field, config.rows_per_salt).select("src", "dst").distinct()
        found.append(materialize(edges, "lsh-edges") if step < config.num_buckets else edges)
    return reduce(DataFrame.unionByName, found)


def fuzzy_duplicates(df: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``(id, group)`` of every document with a near duplicate."""
    return connected_components(fuzzy_edges(df, config), id_field=config.id_field, rows_per_salt=config.rows_per_salt)


def fuzzy_duplicates_to_remove(df: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """``(id, group)`` of all but the first of each group."""
    # The group is named by its smallest id, which is the first.
    return fuzzy_duplicates(df, config).filter(F.col(config.id_field) != F.col("group"))


def remove_fuzzy_duplicates(df: DataFrame, config: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    return remove_ids(df, fuzzy_duplicates_to_remove(df, config), config.id_field)
