"""Remove from documents the passages that also occur in evaluation tasks.

A passage is a run of ``n`` words of a task, or all its words if it has fewer.  Words are runs of letters and digits;
letter case and punctuation are ignored.

Tasks up to ``block_chars`` characters are shared with all executors: a word becomes its number in the passages' vocabulary,
most become none, and rolling hashes of the numbers name the few places that are compared in full.  Documents are neither
shuffled nor exploded.  Larger benchmarks stay a table.  Their passages' hashes set bits in a sketch of one size, which is all that a
task holds; places of a document whose hash meets a bit are joined with the passages by hash and words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import materialize, written_with_row_id

BLOCK_CHARS = 4_000_000  # characters of tasks that are shared with all executors
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Passages:
    """The passages of some tasks, by length."""

    def __init__(self, texts: Iterable[str], n: int):
        self.vocabulary: dict[str, int] = {}
        self.runs: dict[int, set[bytes]] = defaultdict(set)
        for text in texts:
            words = _WORD.findall(text.lower())
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            size = min(n, len(ids))
            self.runs[size].update(ids[at : at + size].tobytes() for at in range(len(ids) - size + 1) if size)
        self.names = {}
        for size, runs in self.runs.items():
            if size and runs:
                table = np.frombuffer(b"".join(runs), np.uint64)  # each run begins at a multiple of its size
                self.names[size] = np.unique(self._names(table, size)[::size])

    @staticmethod
    def _names(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` numbers, modulo 2^64."""
        count = len(ids) - size + 1
        name = np.zeros(max(count, 0), np.uint64)
        for k in range(size):
            name = name * _BASE + ids[k : k + count]
        return name ^ (name >> np.uint64(31))

    def hits(self, text: str) -> list[tuple[int, int]]:
        """Place and number of words of every passage in the text."""
        known = self.vocabulary
        ids = np.array([known.get(w, 0) for w in _WORD.findall(text.lower())], np.uint64)
        found = []
        for size, names in self.names.items():
            if len(ids) >= size:
                for at in np.flatnonzero(np.isin(self._names(ids, size), names)).tolist():
                    if ids[at : at + size].tobytes() in self.runs[size]:
                        found.append((at, size))
        return sorted(found)


def _finder(shared):
    @F.pandas_udf("array<struct<pos int, n_words int>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"pos": p, "n_words": k} for p, k in shared.value.hits(t)] for t in texts], dtype=object)

    return find.asNondeterministic()


SKETCH_BITS = 1 << 27  # 16 MB
_PIECE = 1 << 16  # bytes of the sketch that are merged at a time


def _runs(text: str, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Per length, the hash of every run of so many words, and the words."""
    words = _WORD.findall(text.lower())
    if not words:
        return
    ids = pd.util.hash_array(np.array(words, dtype=object))
    for size in lengths:
        if 0 < size <= len(words):
            yield size, Passages._names(ids, size) + np.uint64(size), words


def _bits(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _BASE) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)


def passage_table(tasks: DataFrame, n: int) -> DataFrame:
    """``(size, hash, words)`` of the distinct passages."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                for size, hashes, words in _runs(text, [min(n, len(_WORD.findall(text.lower())))]):
                    rows += [(size, h, " ".join(words[at : at + size])) for at, h in enumerate(hashes.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["size", "hash", "words"])

    return materialize(tasks.mapInPandas(cut, "size int, hash long, words string").distinct(), "passages")


def sketch(passages: DataFrame) -> np.ndarray:
    """The bits that the passages set, as bytes; every task returns pieces of it, which are merged one by one."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(SKETCH_BITS // 8, np.uint8)
        for batch in batches:
            at = _bits(batch["hash"].to_numpy(np.int64).view(np.uint64))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = bits.reshape(-1, _PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        yield pd.DataFrame({"piece": used, "bits": [pieces[i].tobytes() for i in used]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        merged = np.zeros(_PIECE, np.uint8)
        for bits in rows["bits"]:
            merged |= np.frombuffer(bits, np.uint8)
        return pd.DataFrame({"piece": rows["piece"][:1], "bits": [merged.tobytes()]})

    pieces = passages.select("hash").mapInPandas(mark, "piece int, bits binary").groupBy("piece").applyInPandas(merge, "piece int, bits binary")
    out = np.zeros((SKETCH_BITS // 8 // _PIECE, _PIECE), np.uint8)
    for row in pieces.toLocalIterator():
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _hits_by_join(df: DataFrame, tasks: DataFrame, n: int, text_field: str, hits: str) -> DataFrame:
    rows, uid = written_with_row_id(df, "searched")
    passages = passage_table(tasks, n)
    lengths = sorted(r["size"] for r in passages.select("size").distinct().collect())  # n at most
    shared = df.sparkSession.sparkContext.broadcast(sketch(passages))  # SKETCH_BITS, whatever the benchmark

    @F.pandas_udf("array<struct<pos int, size int, hash long, words string>>")
    def maybe(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = []
            for size, hashes, words in _runs(text or "", lengths):
                bit = _bits(hashes)
                for at in np.flatnonzero(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).tolist():
                    found.append({"pos": at, "size": size, "hash": int(hashes[at : at + 1].view(np.int64)[0]), "words": " ".join(words[at : at + size])})
            out.append(found)
        return pd.Series(out, dtype=object)

    places = rows.select(uid, maybe.asNondeterministic()(text_field).alias("maybe")).select(uid, F.inline("maybe"))
    places = materialize(places, "maybe-passages")
    key = ["size", "hash", "words"]
    weights = places.groupBy(*key).agg(F.count("*").alias("n"))
    sure = join_by_heavy_key(places, passages, key, weights, "left_semi")
    hit = F.struct("pos", F.col("size").alias("n_words"))
    listed = sure.groupBy(uid).agg(F.array_sort(F.collect_list(hit)).alias(hits))  # as many as a document has places
    none = F.array().cast("array<struct<pos:int,n_words:int>>")
    return rows.join(listed, uid, "left").withColumn(hits, F.coalesce(hits, none)).drop(uid)


def with_hits(df: DataFrame, benchmark: DataFrame, n: int, text_field: str, benchmark_text: str, hits: str, block_chars: int) -> DataFrame:
    """Add ``hits``: the places and lengths of all benchmark passages, an empty array for none or a null text."""
    tasks = benchmark.select(F.col(benchmark_text).alias("text")).filter("text IS NOT NULL").distinct()
    if (tasks.agg(F.sum(F.length("text"))).first()[0] or 0) > block_chars:
        return _hits_by_join(df, tasks, n, text_field, hits)
    shared = df.sparkSession.sparkContext.broadcast(Passages([r["text"] for r in tasks.collect()], n))  # block_chars at most
    return df.withColumn(hits, F.array_sort(_finder(shared)(text_field)))


def contaminated_positions(
    df: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    id_field: str = "id",
    text_field: str = "text",
    benchmark_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id, pos, n_words)`` of each benchmark passage in a document, ``pos`` being its first word, 0-based."""
    found = with_hits(df.select(id_field, text_field), benchmark, n, text_field, benchmark_text, "_hits", block_chars)
    return found.select(id_field, F.inline("_hits"))


def _without(text: Column, hits: Column, min_chars: int) -> Column:
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series, found: pd.Series) -> pd.Series:
        rows = []
        for t, places in zip(texts, found):
            if t is None:
                rows.append(None)
                continue
            spans = [m.span() for m in _WORD.finditer(t)]
            cuts, at = [], 0
            for place in places:
                begin, end = spans[place["pos"]][0], spans[place["pos"] + place["n_words"] - 1][1]
                if begin > at:
                    cuts.append(t[at:begin])
                at = max(at, end)
            cuts.append(t[at:])
            rows.append([c.strip() for c in cuts if len(c.strip()) >= max(min_chars, 1)])
        return pd.Series(rows, dtype=object)

    return pieces.asNondeterministic()(text, hits)


def remove_contaminated_sections(
    df: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    id_field: str = "id",
    text_field: str = "text",
    min_chars: int = 0,
    max_pieces: int | None = None,
    benchmark_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Cut the passages out.  A touched document becomes one row per remaining piece, numbered in ``piece``.

    Every piece that is not blank is kept.  On request, pieces under ``min_chars`` go, and documents that fall into more
    than ``max_pieces``.  Untouched documents stay as they are, with piece 0.
    """
    found = with_hits(df, benchmark, n, text_field, benchmark_text, "_hits", block_chars)
    hit = F.size("_hits") > 0
    # Only the text of touched documents is cut.
    cut = found.withColumn("_cut", _without(F.when(hit, F.col(text_field)), F.col("_hits"), min_chars))
    if max_pieces is not None:
        cut = cut.filter(~hit | (F.size("_cut") <= max_pieces))
    pieces = F.when(hit, F.col("_cut")).otherwise(F.array(text_field))
    rows = cut.select(*df.columns, F.posexplode(pieces).alias("piece", "_piece"))
    return rows.withColumn(text_field, F.col("_piece")).drop("_piece")


def remove_contaminated_documents(
    df: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    id_field: str = "id",
    text_field: str = "text",
    benchmark_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Drop every document with a benchmark passage."""
    return with_hits(df, benchmark, n, text_field, benchmark_text, "_hits", block_chars).filter(F.size("_hits") == 0).drop("_hits")
