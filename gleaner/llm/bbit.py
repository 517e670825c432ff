"""Near duplicates by b-bit MinHash (Li and König 2010): bands name candidates, packed low bits of the minima estimate
their similarity by bit counts, full shingle sets confirm.

Documents are linked when the Jaccard similarity of their shingle sets is ``similarity`` or more; the result names the
connected component of each.  No group is ever compared all against all as a whole:

1. Documents of equal sets become one representative, in one grouping that combines before the shuffle.
2. Every representative of a band's bucket is compared with the smallest one of it: one pair per member.
3. Confirmed pairs give components.  Only buckets that still hold several components are looked at again: cut into blocks
   of bounded bytes, each pair of blocks is one task, which compares members of different components only and
   stops as soon as they are joined.  It returns links, never pairs.  So no link between components is lost, whatever a
   bucket's size.

With 32 bands of 4 minima, two sets of similarity 0.8 share no bucket with probability 5e-8.  The estimate drops a pair
only when it lies ``margin`` standard deviations under the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.frames import unused
from gleaner.llm.words import LOWER, SPACE, Words, cut_words, mix, parts, texts_of, windows
from gleaner.operators.components import connected_components
from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import discard, materialize, scratch_path

BITS = 4
LANES = 64 // BITS
BLOCK_SHINGLES = 1 << 20  # shingles (8 bytes each) in a block of a bucket


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(n)
    return random.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), random.integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_sets(words: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text after text, and the bounds of the texts in them.

    A text of fewer than ``size`` words, but at least one, has one shingle: all its words.
    """
    at, hashes = windows(words, size)
    text = words.text[at]
    first = words.first(n_texts)
    count = np.diff(first)
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            whole = sum((words.hashes[first[short] + i] * np.uint64(2 * i + 0x9E3779B97F4A7C15) for i in range(n)), np.zeros(len(short), np.uint64))
            text, hashes = np.r_[text, short], np.r_[hashes, mix(whole + np.uint64(n))]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])] if len(text) else np.zeros(0, bool)
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def minima(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima for each nonempty set, one row each; blocks of sets stay within the processor's cache."""
    a, b = permutations(n)
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), n), np.uint64)
    i = 0
    while i < len(full):
        low = bounds[full[i]]
        j = max(int(np.searchsorted(bounds[full + 1], low + 32768, "right")), i + 1)
        block, starts = hashes[low : bounds[full[j - 1] + 1]], bounds[full[i:j]] - low
        for k in range(n):
            out[i:j, k] = np.minimum.reduceat(block * a[k] + b[k], starts)
        i = j
    return out


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit numbers that name each set, whatever the order of its members."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(seed)))]
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


SIGNED = "doc_id long, n long, s1 long, s2 long, packed array<long>, bands array<long>"


def sign_task(size: int, bands: int, rows: int):
    """For ``mapInArrow``: set size, 128-bit name of the set, packed low bits of the minima and band names per document."""
    long_list = pa.list_(pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "s1", "s2")] + [("packed", long_list), ("bands", long_list)])
    n_minima = bands * rows

    def lists(table: np.ndarray, count: np.ndarray) -> pa.Array:
        width = table.shape[1]
        offsets = np.r_[0, np.cumsum(np.where(count > 0, width, 0))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.reshape(-1).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                n = part.num_rows
                hashes, bounds = shingle_sets(cut_words(*texts_of(part.column("text")), SPACE, LOWER), n, size)
                count = np.diff(bounds)
                least = minima(hashes, bounds, n_minima)
                names = set_names(hashes, bounds)
                low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(len(least), n_minima // LANES, LANES)
                packed = (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
                band = np.zeros((len(least), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least.reshape(len(least), bands, rows)[:, :, r])
                yield pa.record_batch(
                    [part.column("doc_id"), count.astype(np.int64), *names, lists(packed, count), lists(band, count)],
                    schema=schema,
                )

    return run


def sets_task(size: int):
    """For ``mapInArrow``: the 128-bit name of each document's set and its sorted shingle hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                hashes, bounds = shingle_sets(cut_words(*texts_of(part.column("text")), SPACE, LOWER), part.num_rows, size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), *set_names(hashes, bounds), lists], schema=schema)

    return run


def least_agreement(similarity: float, n_minima: int, margin: float) -> int:
    """The lanes that must agree: the expected number at ``similarity``, chance agreement included, less ``margin`` deviations."""
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * similarity
    return max(0, int(n_minima * agree - margin * sqrt(n_minima * agree * (1 - agree))))


def agreeing_lanes(a: str, b: str):
    """Number of equal lanes of two packed signatures, by bit counts: a lane differs if any bit of the exclusive or is set."""

    def differing(x, y):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.size(a) * LANES - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def local_links(similarity: float, least: int):
    """For ``applyInArrow``: links between different components among the members of two blocks of a bucket."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, comps, side = (table.column(c).to_numpy() for c in ("rep", "comp", "side"))
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        sizes = table.column("n").to_numpy()[order]
        ids, comps, side = ids[order], comps[order], side[order]
        packed = np.array(table.column("packed").to_pylist(), np.int64).view(np.uint64)[order]
        sets = table.column("shingles").combine_chunks()
        if isinstance(sets, pa.ChunkedArray):
            sets = sets.chunk(0)
        values, offsets = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        one_block = bool((side == side[0]).all())
        parent = {int(c): int(c) for c in comps}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        def members(i: int) -> np.ndarray:
            return values[offsets[order[i]] : offsets[order[i] + 1]]

        links = []
        ones = np.uint64(0x1111111111111111)
        for i in range(len(ids)):
            to = int(np.searchsorted(sizes, int(sizes[i] / similarity) + 1, "right"))
            d = packed[i + 1 : to] ^ packed[i]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            agree = packed.shape[1] * LANES - np.bitwise_count(d & ones).sum(axis=1, dtype=np.int64)
            maybe = (agree >= least) & (comps[i + 1 : to] != comps[i])
            if not one_block:
                maybe &= side[i + 1 : to] != side[i]
            for j in (np.flatnonzero(maybe) + i + 1).tolist():
                a, b = root(int(comps[i])), root(int(comps[j]))
                if a == b:
                    continue
                both = len(np.intersect1d(members(i), members(j), assume_unique=True))
                if both * 100 >= round(similarity * 100) * (int(sizes[i] + sizes[j]) - both):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(comps[i]), int(comps[j])))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], schema=schema)

    return run


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    similarity: float = 0.8,
    bands: int = 32,
    rows: int = 4,
    margin: float = 5.0,
    block_shingles: int = BLOCK_SHINGLES,
    rows_per_salt: int = 1000,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are ``size`` words, or all words of a
    shorter text.  A null or empty text has no shingles and is linked with nothing.  Rows of one id are one node.  A row
    without an id is linked with nothing: its component is null and it is kept.  Other columns are not read.
    """
    spark = docs.sparkSession
    freed: dict[str, str] = {}

    def written(df: DataFrame, label: str) -> DataFrame:
        freed[label] = scratch_path(spark, f"bbit-{label}")
        return materialize(df, label, freed[label])

    def free(*labels: str) -> None:
        for label in labels:
            discard(spark, freed.pop(label))

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialize(docs.mapInArrow(sign_task(size, bands, rows), SIGNED), "bbit-signed")
    known = signed.filter("doc_id IS NOT NULL AND n > 0")

    # Equal sets: the smallest id stands for all.  A set that a third of all documents have is spread over tasks.  A set is named
    # by s1 and s2; where one id has rows of several texts, each of their sets goes its way under the same ``rep``.
    same, name = ["s1", "s2", "size"], ["s1", "s2"]
    known = known.withColumnRenamed("n", "size")
    groups = written(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "groups")
    is_rep = F.col("doc_id") == F.col("rep")
    joined = join_by_heavy_key(known, groups.drop("n"), same, groups, rows_per_salt=rows_per_salt)
    grouped = joined.select(
        "doc_id", "rep", *name, F.col("size").alias("n"), F.when(is_rep, F.col("packed")).alias("packed"), F.when(is_rep, F.col("bands")).alias("bands")
    )
    grouped = materialize(grouped, "bbit-grouped")
    free("groups")
    reps = grouped.filter(is_rep).dropDuplicates(name).select("rep", *name, "n", "packed", "bands")

    # Buckets of two and more, each with its smallest member.  A bucket may hold a third of all sets, so its rows are spread.
    in_band = reps.select("rep", *name, F.explode("bands").alias("bucket"))
    member = F.struct("rep", *name)
    buckets = in_band.groupBy("bucket").agg(F.min(member).alias("centre"), F.max(member).alias("last"), F.count("*").alias("n")).filter("centre < last")
    buckets = written(buckets.select("bucket", F.col("centre.rep").alias("c_rep"), F.col("centre.s1").alias("c1"), F.col("centre.s2").alias("c2"), "n"), "centres")
    in_bucket = written(join_by_heavy_key(in_band, buckets.drop("n"), "bucket", buckets, rows_per_salt=rows_per_salt), "buckets")
    needed = in_bucket.select("rep", *name).distinct()
    texts = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(sets_task(size), "doc_id long, s1 long, s2 long, shingles array<long>").withColumnRenamed("doc_id", "rep")
    sets = sets.join(needed, ["rep", *name], "left_semi").dropDuplicates(name)
    sets = written(sets.join(reps.select(*name, "n", "packed"), name), "sets")

    # Each member against its bucket's smallest, which may have very many.
    least = least_agreement(similarity, bands * rows, margin)
    per_cent = round(similarity * 100)
    centre = ["c1", "c2"]
    pairs = written(in_bucket.filter("rep <> c_rep").select("rep", *name, "c_rep", *centre).distinct(), "candidates")
    weights = pairs.groupBy(*centre).agg(F.count("*").alias("n"))
    narrow = sets.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("n2"), F.col("packed").alias("packed2"))
    pairs = join_by_heavy_key(pairs.join(sets.select(*name, "n", "packed"), name), narrow, centre, weights, rows_per_salt=rows_per_salt)
    alike = (F.least("n", "n2") * 100 >= per_cent * F.greatest("n", "n2")) & (agreeing_lanes("packed", "packed2") >= least)
    pairs = written(pairs.filter(alike).select("rep", *name, "c_rep", *centre, "n", "n2"), "alike")
    weights = pairs.groupBy(*centre).agg(F.count("*").alias("n"))
    of_centre = sets.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("shingles").alias("shingles2"))
    with_sets = join_by_heavy_key(pairs.join(sets.select(*name, "shingles"), name), of_centre, centre, weights, rows_per_salt=rows_per_salt)
    common = F.size(F.array_intersect("shingles", "shingles2"))
    links = with_sets.withColumn("both", common).filter(F.col("both") * 100 >= per_cent * (F.col("n") + F.col("n2") - F.col("both")))
    comps = connected_components(links.select(F.col("rep").alias("src"), F.col("c_rep").alias("dst")), id_field="rep").withColumnRenamed("group", "comp")
    free("candidates", "alike")

    # Buckets that still hold several components, each set of members once.
    placed = in_bucket.select("bucket", "rep", *name).join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = written(placed, "placed")
    free("buckets", "centres")
    members = [F.sum(F.xxhash64(*name).cast("decimal(38,0)")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), *name)).alias("m2"), F.count("*").alias("m3")]
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *members).filter("low < high")
    mixed = written(mixed.groupBy("m1", "m2", "m3").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("m3").alias("n")), "mixed")
    still_open = join_by_heavy_key(placed, mixed.drop("n"), "bucket", mixed, rows_per_salt=rows_per_salt)
    open_rows = written(still_open.join(sets, name).select("bucket", placed["rep"], *name, "comp", "n", "packed", "shingles"), "open")
    free("placed", "sets", "mixed")
    blocks = written(open_rows.groupBy("bucket").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"), F.count("*").alias("n")), "blocks")
    cut = join_by_heavy_key(open_rows.withColumnRenamed("n", "size"), blocks.drop("n"), "bucket", blocks, rows_per_salt=rows_per_salt)
    cut = cut.withColumnRenamed("size", "n").withColumn("side", F.pmod(F.xxhash64(*name), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("side", o).alias("a"), F.greatest("side", o).alias("b")))
    paired = cut.withColumn("pair", F.explode(others)).select("bucket", "pair", "side", "rep", "comp", "n", "packed", "shingles")
    # Dealt out by bucket and pair: the pairs of one bucket are tasks of their own.
    rest = paired.repartition("bucket", "pair").groupBy("bucket", "pair").applyInArrow(local_links(similarity, least), "src long, dst long")
    merged = connected_components(rest, id_field="comp")
    free("open", "blocks")

    final = comps.join(merged, "comp", "left").select("rep", F.coalesce("group", "comp").alias("component"))
    alone = merged.select(F.col("comp").alias("rep"), F.col("group").alias("component")).join(comps, "rep", "left_anti")
    final = final.unionByName(alone)
    ids = grouped.select("doc_id", "rep").distinct().join(final, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("doc_id", "n").join(ids, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; every column as it is.

    Rows of one id stay or go together; rows without an id or without words stay.
    """
    (name,) = unused(docs, "gone")
    gone = near_duplicates(docs, **settings).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
