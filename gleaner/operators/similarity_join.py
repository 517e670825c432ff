"""Set-similarity join within LSH buckets: which members of a bucket really are near duplicates.

The sets are the distinct character n-grams, as 64-bit hashes.  A fixed number of jobs, whatever a bucket holds:

1. Every member is compared with the smallest of its bucket.  Copies, however many, are joined here by one pair each.
2. Buckets that still hold several components go through prefix and position filters (Chaudhuri et al. 2006; Xiao et al.
   2008).  A member's n-grams are put in order from rare to frequent; two sets can only reach the similarity if they share one
   of their first ``size - ceil(similarity * size) + 1``, and if what follows it is long enough.  Members that have nothing
   rare in common are never paired, so a bucket of many unlike texts stays cheap.  Equal sets of a bucket count as one.
3. The pairs that pass are compared in full.

The order needs frequencies that are alike for all tasks, not exact ones: they are counted in a fixed number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.minhash import shingle_hashes
from gleaner.functions.slices import SLICE_BYTES, by_slices, list_array, spans
from gleaner.operators.components import connected_components
from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import materialize

CELLS = 1 << 20


def shingle_sets(text: Column, width: int) -> Column:
    """The sorted hashes of the distinct character n-grams; a shorter text is its own single one."""

    def sets(texts: list[str]) -> pa.Array:
        return list_array([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], pa.int64())

    return by_slices(sets, "array<long>")(text)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    return (row.values.to_numpy() for row in column)


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold an n-gram of each cell; a task returns a row per cell at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for hashes in _lists(batch.column(0)):
                np.add.at(total, _cells(hashes), 1)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["cell", "n"])

    summed = sets.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def least_common(similarity: float, size: np.ndarray | int) -> np.ndarray:
    """The n-grams that a set of this size must share with another one to reach the similarity."""
    return np.ceil(similarity * np.asarray(size) - 1e-9).astype(np.int64)


def prefixes(sets: DataFrame, id_field: str, similarity: float, counts: np.ndarray) -> DataFrame:
    """``(id, size, pos, shingle)``: the first n-grams of each set in order from rare to frequent."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers
    kind = sets.schema[id_field].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, which = [], []
        for row, hashes in enumerate(_lists(batch.column(1))):
            order = np.lexsort((hashes, shared.value[_cells(hashes)]))
            n = len(hashes) - int(least_common(similarity, len(hashes))) + 1
            parts.append(hashes[order[:n]])
            which.append(np.full(min(n, len(hashes)), row))
        held, shingle = np.concatenate(which), np.concatenate(parts)
        sizes = np.array([len(h) for h in _lists(batch.column(1))], np.int64)
        pos = np.arange(len(held)) - np.searchsorted(held, held, "left")
        return pa.record_batch(
            [batch.column(0).take(pa.array(held)), pa.array(sizes[held]), pa.array(pos), pa.array(shingle)], [id_field, "size", "pos", "shingle"]
        )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy() * 8
            for start, stop in spans(sizes, 4 * SLICE_BYTES):  # a set is eight times its text
                yield part(batch.slice(start, stop - start))

    return sets.select(id_field, "shingles").mapInArrow(first, f"`{id_field}` {kind}, size long, pos long, shingle long")


def _compared(pairs: DataFrame, sets: DataFrame, id_field: str, similarity: float, rows_per_salt: int | None) -> DataFrame:
    """The distinct ``(src, dst)`` whose sets reach the similarity.  An end with many pairs is spread over tasks."""
    for end in ("dst", "src"):
        weights = pairs.groupBy(end).agg(F.count("*").alias("n"))
        side = sets.select(F.col(id_field).alias(end), F.col("shingles").alias(f"{end}_set"))
        pairs = join_by_heavy_key(pairs, side, end, weights, rows_per_salt=rows_per_salt)
    common = F.size(F.array_intersect("src_set", "dst_set"))
    union = F.size("src_set") + F.size("dst_set") - common
    return pairs.filter(common / union >= similarity).select("src", "dst")


def confirmed_edges(
    buckets: DataFrame,
    df: DataFrame,
    id_field: str,
    text_field: str,
    width: int,
    similarity: float,
    key: Sequence[str] = ("band", "h1", "h2"),
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Edges ``(src, dst)``, src the larger id, that join what is alike in a bucket.

    Every edge joins two members of one bucket whose n-gram sets have the Jaccard similarity ``similarity`` or more, and any two
    such members are joined by a path of edges.  ``df`` holds each id once, with a text that is not empty.
    """
    key = list(key)
    ids = F.col(id_field)
    centres = buckets.groupBy(*key).agg(F.min(id_field).alias("centre"), F.max(id_field).alias("last"), F.count("*").alias("n"))
    centres = materialize(centres.filter("centre < last").drop("last"), "centres")
    members = join_by_heavy_key(buckets.select(id_field, *key), centres.drop("n"), key, centres, rows_per_salt=rows_per_salt)
    members = materialize(members, "members")
    texts = df.select(id_field, text_field).join(members.select(id_field).distinct(), id_field, "left_semi")
    sets = materialize(texts.select(id_field, shingle_sets(F.col(text_field), width).alias("shingles")), "sets")

    stars = members.filter(ids != F.col("centre")).select(ids.alias("src"), F.col("centre").alias("dst")).distinct()
    links = materialize(_compared(stars, sets, id_field, similarity, rows_per_salt), "stars")

    comps = connected_components(links, id_field=id_field, rows_per_salt=rows_per_salt).withColumnRenamed("group", "comp")
    named = sets.select(id_field, F.xxhash64("shingles").alias("s1"), F.xxhash64(F.lit(1), "shingles").alias("s2"), F.size("shingles").alias("s3"))
    member_weights = members.groupBy(id_field).agg(F.count("*").alias("n"))
    placed = join_by_heavy_key(members, comps, id_field, member_weights, "left", rows_per_salt).withColumn("comp", F.coalesce("comp", id_field))
    placed = materialize(join_by_heavy_key(placed, named, id_field, member_weights, rows_per_salt=rows_per_salt), "placed")
    still_open = placed.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high")
    still_open = materialize(still_open.select(*key, "n"), "open-buckets")
    left = materialize(join_by_heavy_key(placed, still_open.drop("n"), key, still_open, "left_semi", rows_per_salt), "open-members")

    # Equal sets of a bucket: the smallest id stands for all.
    name = [*key, "s1", "s2", "s3"]
    reps = left.groupBy(*name).agg(F.min(id_field).alias("rep"), F.min(F.struct(id_field, "comp"))["comp"].alias("comp"), F.count("*").alias("n"))
    reps = materialize(reps, "equal-sets")
    copies = join_by_heavy_key(left.select(id_field, *name), reps.drop("comp", "n"), name, reps, rows_per_salt=rows_per_salt)
    copies = copies.filter(ids != F.col("rep")).select(ids.alias("src"), F.col("rep").alias("dst")).distinct()

    rep_ids = reps.select(F.col("rep").alias(id_field)).distinct()
    open_sets = materialize(sets.join(rep_ids, id_field, "left_semi"), "open-sets")
    first = prefixes(open_sets, id_field, similarity, cell_counts(open_sets))
    rows = reps.select(*key, F.col("rep").alias(id_field), "comp").join(first, id_field)
    place = [*key, "shingle"]
    mixed = rows.groupBy(*place).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select(*place)
    rows = materialize(rows.join(mixed, place, "left_semi"), "prefixes")
    one = rows.select(*place, *(F.col(c).alias(f"{c}_1") for c in (id_field, "comp", "size", "pos")))
    two = rows.select(*place, *(F.col(c).alias(f"{c}_2") for c in (id_field, "comp", "size", "pos")))
    pairs = one.join(two, place).filter((F.col(f"{id_field}_1") > F.col(f"{id_field}_2")) & (F.col("comp_1") != F.col("comp_2")))
    needed = F.ceil((F.col("size_1") + F.col("size_2")) * F.lit(similarity / (1 + similarity)) - 1e-6)
    rest = F.least(F.col("size_1") - F.col("pos_1"), F.col("size_2") - F.col("pos_2"))
    pairs = pairs.filter(rest >= needed).select(F.col(f"{id_field}_1").alias("src"), F.col(f"{id_field}_2").alias("dst")).distinct()
    more = _compared(materialize(pairs, "pairs"), open_sets, id_field, similarity, rows_per_salt)
    return links.unionByName(copies).unionByName(more).distinct()
