"""Benchmark decontamination by Wu-Manber multi-pattern search (Wu and Manber 1994) over words.

The patterns are the benchmark's windows of ``size`` words; an item with fewer words is one pattern.  For the patterns of
one length a table over hashed blocks of two words tells how far the search may shift: the full length less one when the
block is in no pattern.  Blocks that end a pattern shift by zero; their hash and that of the pattern's first block select the
few patterns to test, and a direct comparison of the words' bytes confirms.  All stretches of text in a batch move forward
together, as numpy arrays.

The patterns are taken in blocks of a bounded number of windows.  With one block, the common case, documents are neither
shuffled nor written: the search is a column added to the rows.  With more, the rows are written once with a number; each block
is a pass that writes what it found by that number, and its patterns are freed before the next one.  So what a task holds
does not grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from gleaner.llm.frames import unused
from gleaner.llm.words import LOWER, NON_ALNUM, Words, cut_words, mix, parts, texts_of
from gleaner.session import materialize, written_with_row_id

BLOCK = 2
STRETCH = 1024  # words of a text searched in one stretch; stretches overlap by a pattern's length less one
TABLE_BITS = 22
BLOCK_WINDOWS = 500_000
COMPARED = 50_000  # places compared at a time


def same_words(a: Words, at: np.ndarray, b: Words, bt: np.ndarray) -> np.ndarray:
    """Whether the words ``a[at]`` and ``b[bt]`` (index arrays of one shape) have the same bytes."""
    length = (a.ends - a.starts)[at]
    same = length == (b.ends - b.starts)[bt]
    x, y, size = a.starts[at][same], b.starts[bt][same], length[same]
    if len(size):  # a word has at least one byte
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differ = a.data[np.repeat(x, size) + step] != b.data[np.repeat(y, size) + step]
        same[same] = ~np.logical_or.reduceat(differ, first)
    return same


class Patterns:
    """Shift table and buckets of patterns of one length; pattern i is the words from ``first[i]`` on."""

    def __init__(self, length: int, words: Words, first: np.ndarray, items: list[list[str]]):
        self.length, self.words, self.first, self.items = length, words, first, items
        hashes = self.hashes
        self.block = min(BLOCK, length)
        self.bits = min(TABLE_BITS, max(10, int(np.ceil(np.log2(max(1, hashes.size) + 1))) + 4))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 255 else np.int32)
        for end in range(self.block, length + 1):
            name = self.names(hashes[:, end - self.block : end])
            np.minimum.at(self.shift, name, length - end)
        bucket = self.bucket(self.full_names(hashes[:, : self.block]), self.full_names(hashes[:, length - self.block :]))
        order = np.argsort(bucket, kind="stable")
        self.buckets, self.order = bucket[order], order

    @property
    def hashes(self) -> np.ndarray:
        """The words' hashes, a row per pattern."""
        return self.words.hashes[self.first[:, None] + np.arange(self.length)]

    @staticmethod
    def bucket(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return mix(suffix) ^ prefix

    def full_names(self, blocks: np.ndarray) -> np.ndarray:
        name = blocks[:, 0]
        for i in range(1, blocks.shape[1]):
            name = mix(name + np.uint64(i)) ^ blocks[:, i]
        return name

    def names(self, blocks: np.ndarray) -> np.ndarray:
        return (mix(self.full_names(blocks)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and number of the pattern, for every occurrence."""
        h, length, block = words.hashes, self.length, self.block
        n = len(h)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        full = h if block == 1 else mix(h[:-1] + np.uint64(1)) ^ h[1:]
        shift_at = self.shift[(mix(full) >> np.uint64(64 - self.bits)).astype(np.int64)]  # by the block's first word
        first = words.first(n_texts)
        begin, stop = first[:-1], first[1:]
        count = np.maximum(0, -(-(stop - begin - length + 1) // STRETCH))
        text = np.repeat(np.arange(n_texts), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[text] + nth * STRETCH + length - 1  # the last word of the window under test
        last = np.minimum(at + STRETCH, stop[text])
        found = []
        while len(at):
            jump = shift_at[at - block + 1].astype(np.int64)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < last
            at, last = at[on], last[on]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        wanted = self.bucket(full[ends - length + 1], full[ends - block + 1])
        low, high = (np.searchsorted(self.buckets, wanted, side) for side in ("left", "right"))
        some = high > low
        ends, low, high = ends[some], low[some], high[some]
        starts, numbers = [], []
        while len(ends):  # the bucket's patterns one after the other, all places together
            number = self.order[low]
            for i in range(0, len(ends), COMPARED):
                window = ends[i : i + COMPARED, None] + np.arange(1 - length, 1)
                mine = number[i : i + COMPARED]
                same = same_words(words, window, self.words, self.first[mine][:, None] + np.arange(length)).all(axis=1)
                starts.append(window[same, 0])
                numbers.append(mine[same])
            low = low + 1
            on = low < high
            ends, low, high = ends[on], low[on], high[on]
        return (np.concatenate(starts), np.concatenate(numbers)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def build_patterns(rows: list[tuple[str, str | None]], size: int) -> list[Patterns]:
    """Patterns of ``(item, text)`` rows, by length; equal windows of several items are one pattern with their names."""
    if not rows:
        return []
    words = cut_words(*texts_of(pa.array([t for _, t in rows], pa.large_string())), NON_ALNUM, LOWER)
    first = words.first(len(rows))
    plain = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)]
    by_length: dict[int, dict[bytes, tuple[int, set[str]]]] = defaultdict(dict)
    for i, (item, _) in enumerate(rows):
        begin, stop = int(first[i]), int(first[i + 1])
        length = min(size, stop - begin)
        for at in range(begin, stop - length + 1 if length else begin):
            by_length[length].setdefault(b" ".join(plain[at : at + length]), (at, set()))[1].add(item)
    return [
        Patterns(length, words, np.array([at for at, _ in windows.values()]), [sorted(names) for _, names in windows.values()])
        for length, windows in sorted(by_length.items())
    ]


FOUND_TYPE = StructType(
    [
        StructField("n_words", LongType()),
        StructField("starts", ArrayType(IntegerType())),
        StructField("ends", ArrayType(IntegerType())),
        StructField("items", ArrayType(StringType())),
    ]
)


def search_task(shared):
    """For an Arrow function of one text column: words, runs of hit words and names of the items found."""

    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        pieces = []
        for part in parts(pa.record_batch([column], ["text"])):
            m = part.num_rows
            words = cut_words(*texts_of(part.column("text")), NON_ALNUM, LOWER)
            first = words.first(m)
            step = np.zeros(len(words.hashes) + 1, np.int64)
            names: list[set[str]] = [set() for _ in range(m)]
            for patterns in shared.value:
                starts, numbers = patterns.search(words, m)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + patterns.length, -1)
                pairs = np.unique(np.stack([words.text[starts], numbers], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
                for text, number in pairs.tolist():
                    names[text].update(patterns.items[number])
            hit = np.r_[False, np.cumsum(step[:-1]) > 0, False]
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            # A run of hits never crosses from one text to the next unless both touch; cut it there.
            begin, end = edge[::2], edge[1::2]
            inner = first[1:-1]
            inner = inner[hit[inner] & hit[inner + 1]] if len(inner) else inner
            begin, end = np.sort(np.r_[begin, np.unique(inner)]), np.sort(np.r_[end, np.unique(inner)])
            full = end > begin
            begin, end = begin[full], end[full]
            text = words.text[begin]
            offsets = np.searchsorted(text, np.arange(m + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array((x - first[text]).astype(np.int32))) for x in (begin, end)]
            pieces.append(pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), *lists, pa.array([sorted(x) for x in names], pa.list_(pa.string()))], ["n_words", "starts", "ends", "items"]))
        if not n:
            return pa.array([], pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))
        return pa.concat_arrays(pieces)

    return run


def _hit_words(runs) -> F.Column:
    """Words covered by runs ``(s, e)`` that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("to"))
    return F.aggregate(
        F.array_sort(runs),
        start,
        lambda acc, r: F.struct((acc["total"] + F.greatest(r["e"] - F.greatest(r["s"], acc["to"]), F.lit(0))).alias("total"), F.greatest(r["e"], acc["to"]).alias("to")),
        lambda acc: acc["total"],
    )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, item: str = "item_id", block_windows: int = BLOCK_WINDOWS, out: str = "found") -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``n_hit`` and ``items``, the sorted names of the items that occur.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  ``benchmark`` has ``item``
    and ``text``; a null text or one without words gives no pattern, a null name is the empty name, repeated rows are one.  A null
    document has no words.  A column of ``docs`` named ``out`` is replaced; name another one to keep it.
    """
    spark = docs.sparkSession
    # Distinct items in blocks of a bounded number of windows, each collected for one pass.
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), "text").filter("text IS NOT NULL").distinct()
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * block_windows)

    def search(rows: DataFrame, block: int, name: str):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(build_patterns([(r["item"], r["text"]) for r in mine], size))
        return rows.withColumn(name, F.arrow_udf(search_task(shared), FOUND_TYPE).asNondeterministic()("text")), shared

    runs = lambda f: F.arrays_zip(f["starts"].alias("s"), f["ends"].alias("e"))
    if n_blocks == 1:
        (name,) = unused(docs, "found_words", also=[out])
        f = F.col(name)
        searched, _ = search(docs, 0, name)
        return searched.withColumn(out, F.struct(f["n_words"].alias("n_words"), _hit_words(runs(f)).alias("n_hit"), f["items"].alias("items"))).drop(name)

    rows, row = written_with_row_id(docs, "wumanber-rows")
    passes = []
    for block in range(n_blocks):
        found, shared = search(rows.select(F.col(row).alias("row"), "text"), block, "f")
        # Where nothing is found there is a row of the first pass only, for the number of words.
        kept = found.select("row", "f").filter((F.size("f.items") > 0) | F.lit(block == 0))
        passes.append(materialize(kept.select("row", F.col("f.n_words").alias("n_words"), runs(F.col("f")).alias("runs"), F.col("f.items").alias("items")), "wumanber-pass"))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = every.select(F.col("row").alias(row), F.struct("n_words", _hit_words(F.col("runs")).alias("n_hit"), "items").alias(out))
    return rows.drop(out).join(merged, row).drop(row)


def is_contaminated(found):
    """At least a twentieth of the words lies in occurrences of benchmark windows."""
    return (found["n_hit"] > 0) & (found["n_hit"] * 20 >= found["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` without the contaminated ones; every column as it is."""
    (found,) = unused(docs, "found")
    return benchmark_hits(docs, benchmark, size, out=found).filter(~is_contaminated(F.col(found))).drop(found)
