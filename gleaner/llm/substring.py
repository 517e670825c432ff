"""Removal of word windows that another document holds too, with a count-min prefilter.

A window is ``size`` consecutive words.  It is removed where its word sequence also starts in a document with a smaller
id.  Three passes, none of which gathers the windows of a document or the documents of a window:

1. Each task keeps a sketch of its texts: for every window its *anchor*, the run of ``size // 2`` words inside it with the
   smallest hash, is counted once per text in ``depth`` rows of cells.  Equal windows have equal anchors, so the count of
   an anchor is never below that of any of its windows; neighbouring windows share anchors, so that a text has about four
   of them per ``size`` words.  The tasks' sketches are sparse pieces of 65,536 cells; they are added up per
   piece, in a stream.  Each piece of the merged sketch keeps one bit per cell: counted twice or more.
2. Windows all of whose cells have that bit are the only ones that can be repeated.  A task first settles windows that
   it saw in several documents itself: all but those of the smallest id are repeated.  So a passage that a third of all
   documents hold leaves each task once.  The rest is grouped exactly, on 128 bits of hash, by Spark.
3. Repeated windows are gathered per document, as runs, and joined to the texts.

The merged sketch is broadcast: at most ``depth * max_cells / 8`` bytes, 64 MiB by default.  A corpus too large for it
makes more windows pass to the exact grouping, whose rows grow with the corpus; it loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.words import SECOND_BASE, SPACE, Words, cut_words, mix, parts, texts_of, windows

PIECE = 1 << 16
BUFFER = 1 << 20  # anchors or windows that a task keeps before it hands them on


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of the anchor of each window: its half window with the smallest hash."""
    half = size // 2
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, hashes = windows(words, half)
    full = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    full[starts] = hashes
    width = size - half + 1
    least, have = full, 1  # the smallest over ``have`` neighbours, doubled as often as it fits
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = np.flatnonzero(words.text[: n - size + 1] == words.text[size - 1 :])
    return at, least[at]


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix(hashes + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(cells - 1)


def sketch_task(size: int, depth: int, cells: int):
    """For ``mapInArrow``: the task's sparse sketch, as (piece, cells counted once, cells counted more often)."""

    def flush(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        hashes = np.concatenate(kept)
        for row in range(depth):
            cell, times = np.unique(cells_of(hashes, row, cells), return_counts=True)
            piece = (cell // np.uint64(PIECE)).astype(np.int64)
            place = (cell % np.uint64(PIECE)).astype(np.uint16)
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            last = np.r_[first[1:], len(piece)]
            many = times > 1
            once, more, names = [], [], []
            for a, b in zip(first, last):
                names.append(row * (cells // PIECE) + int(piece[a]))
                once.append(place[a:b][~many[a:b]].tobytes())
                more.append(place[a:b][many[a:b]].tobytes())
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["piece", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            for part in parts(batch):
                words = cut_words(*texts_of(part.column("text")), SPACE)
                at, hashes = anchors(words, size)
                text = words.text[at]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])] if len(at) else np.zeros(0, bool)
                hashes, text = hashes[new], text[new]
                order = np.lexsort((hashes, text))
                hashes, text = hashes[order], text[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])] if len(text) else np.zeros(0, bool)
                kept.append(hashes[new])
                count += int(new.sum())
                if count >= BUFFER:
                    yield from flush(kept)
                    kept, count = [], 0
        yield from flush(kept)

    return run


def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over rows sorted by piece: add up the pieces, keep a bit for each cell counted twice or more."""
    name, count = None, None
    for batch in batches:
        for piece, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            if piece != name:
                if name is not None:
                    yield _bits(name, count)
                name, count = piece, np.zeros(PIECE, np.uint8)
            place = np.frombuffer(once, np.uint16)
            count[place] = np.minimum(count[place] + 1, 2)
            count[np.frombuffer(more, np.uint16)] = 2
    if name is not None:
        yield _bits(name, count)


def _bits(name: int, count: np.ndarray) -> pa.RecordBatch:
    bits = np.packbits(count > 1, bitorder="little").tobytes()
    return pa.record_batch([pa.array([name], pa.int64()), pa.array([bits], pa.binary())], ["piece", "bits"])


def build_sketch(docs: DataFrame, size: int, depth: int, max_cells: int) -> tuple[int, np.ndarray]:
    """The cells per row and the merged sketch's bits, row after row.  ``docs`` has the column ``text``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = PIECE
    while cells < min(total // 10, max_cells):  # a text has about one anchor to 80 bytes
        cells *= 2
    pieces = docs.mapInArrow(sketch_task(size, depth, cells), "piece long, once binary, more binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge_task, "piece long, bits binary")
    bits = np.zeros((depth * cells // PIECE, PIECE // 8), np.uint8)
    for row in merged.toLocalIterator():
        bits[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return cells, bits.reshape(-1)


CANDIDATE = "h1 long, h2 long, doc_id long, text_key long, start int, end int"


def candidate_task(size: int, depth: int, cells: int, shared):
    """For ``mapInArrow``: the windows that the sketch lets pass.  Rows with an ``end`` are settled runs of words."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def flush(kept: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        h1, h2, doc, key, at = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, key, at = h1[order], h2[order], doc[order], key[order], at[order]
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        ask = doc == least
        yield pa.record_batch([h1[ask].view(np.int64), h2[ask].view(np.int64), doc[ask], key[ask], at[ask].astype(np.int32), pa.nulls(int(ask.sum()), pa.int32())], schema=schema)
        doc, key, at = doc[~ask], key[~ask], at[~ask]
        if len(doc):
            order = np.lexsort((at, key, doc))
            doc, key, at = doc[order], key[order], at[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] > at[:-1] + size)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(doc)] - 1
            doc, key, start, end = doc[first], key[first], at[first], at[last] + size
            name = mix(doc.view(np.uint64) + (start.astype(np.uint64) << np.uint64(40)))
            yield pa.record_batch([name.view(np.int64), key, doc, key, start.astype(np.int32), end.astype(np.int32)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        kept, count = [], 0
        for batch in batches:
            for part in parts(batch):
                docs = part.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                keys = part.column("text_key").to_numpy(zero_copy_only=False)
                words = cut_words(*texts_of(part.column("text")), SPACE)
                at, anchor = anchors(words, size)
                maybe = np.ones(len(at), bool)
                for row in range(depth):
                    cell = cells_of(anchor, row, cells) + np.uint64(row * cells)
                    maybe &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if not maybe.any():
                    continue
                _, h1 = windows(words, size)
                _, h2 = windows(words, size, SECOND_BASE)
                at = at[maybe]
                text = words.text[at]
                kept.append((h1[maybe], h2[maybe], docs[text], keys[text], at - words.first(len(docs))[text]))
                count += len(at)
                if count >= BUFFER:
                    yield from flush(kept)
                    kept, count = [], 0
        yield from flush(kept)

    return run


def repeated_runs(docs: DataFrame, size: int = 50, depth: int = 2, max_cells: int = 1 << 28) -> DataFrame:
    """``(doc_id, text_key, runs)``: per document the word runs [start, end) that repeat a document of a smaller id.

    ``docs`` has ``doc_id`` (whole number), ``text`` and ``text_key`` (a hash of the text, which keeps rows of one id
    apart).  Rows without an id, without text or with fewer than ``size`` words give nothing.
    """
    spark = docs.sparkSession
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_key", "text")
    cells, bits = build_sketch(known.select("text"), size, depth, max_cells)
    shared = spark.sparkContext.broadcast(bits)
    found = known.mapInArrow(candidate_task(size, depth, cells, shared), CANDIDATE)
    # At most one row per buffer of a task, for each place of the window in the buffer's smallest document.
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    repeated = found.withColumn("least", least).filter("end IS NOT NULL OR least < doc_id")
    runs = repeated.select("doc_id", "text_key", "start", F.coalesce("end", F.col("start") + size).alias("end"))
    return runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def remove_repeated_substrings(docs: DataFrame, size: int = 50, depth: int = 2, max_cells: int = 1 << 28, keep_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, kept_sha256)`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of anything but ASCII white space; kept words are joined by one space.  A null or empty text has no
    words; a row without an id neither removes nor loses anything; rows of one id never remove from each other; other
    columns are not read.  Without ``keep_text``, ``kept_text`` is null.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    runs = repeated_runs(docs, size, depth, max_cells)
    joined = docs.join(runs, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs.start", "runs.end")
    return joined.mapInArrow(_apply_task(keep_text), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _apply_task(keep_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                n_words, n_removed, kept_texts, sums = [], [], [], []
                data, bounds = texts_of(part.column("text"))
                raw = data.tobytes()
                for i, (starts, ends) in enumerate(zip(part.column("start"), part.column("end"))):
                    words = raw[bounds[i] : bounds[i + 1]].split()
                    total = len(words)
                    if starts.is_valid:
                        step = np.zeros(total + 1, np.int64)
                        np.add.at(step, starts.values.to_numpy(), 1)
                        np.add.at(step, ends.values.to_numpy(), -1)
                        gone = np.cumsum(step[:total]) > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    text = b" ".join(words)
                    n_words.append(total)
                    n_removed.append(total - len(words))
                    kept_texts.append(text.decode() if keep_text else None)
                    sums.append(hashlib.sha256(text).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(sums)], schema=schema)

    return run
