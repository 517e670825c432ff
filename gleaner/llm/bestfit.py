"""Best-fit packing planned on the histogram of lengths.

Tokenised documents are cut into pieces of at most ``capacity`` tokens.  The plan needs only how many pieces there are of
each length, at most ``capacity`` numbers: from the longest length down, best fit puts whole runs of equal pieces into
runs of sequences with equal room.  The plan is a table of runs, whose size depends on ``capacity`` and not on the data;
pieces take their place by a join on their length and their rank among the pieces of that length.

Ranks need no window: pieces are range partitioned by length, written once, and numbered within each partition; the
offsets are one row per partition and length in it.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from struct import pack, unpack

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import unused
from gleaner.llm.words import parts, texts_of
from gleaner.session import materialize

CACHE_WORDS = 250_000  # words whose ids a worker remembers, twice; words of over 64 bytes are not kept
END = 1


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level tokenizers: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, encoded word by word and remembered.

    Right for tokenizers that drop white space and never join what it parts, which is so for any whose first step
    splits at it; tests hold it against encoding whole texts.  Where probes show that the tokenizer lower-cases, takes
    a run of letters and a run of marks as one piece each, and works on bytes, words of that kind go to its model
    directly, which is several times as fast; all others take the tokenizer's whole way.
    """

    MARKS = "".join(chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'")
    PROBES = ("plain", "MiXed", "Éçole", "straße", "niño", "Ａ", "日本", "йод", "e\u0301t\u00e9")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.characters = byte_characters()
        self.direct = True
        self.direct = all(self._encode(w) == self._whole(w) for p in self.PROBES for w in (p, p + "%$", p + ".", p + "!?"))

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack("<%dI" % len(ids), *ids)

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else "".join([self.characters[b] for b in piece.encode()])
            found = [t.id for t in self.model.tokenize(text)]
            ids = pack("<%dI" % len(found), *found)
            if len(self.pieces) > CACHE_WORDS:
                self.pieces.clear()
            if len(piece) <= 32:
                self.pieces[piece] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        if self.direct:
            letters = word.rstrip(self.MARKS)
            low = letters.lower() if letters.isascii() else unicodedata.normalize("NFC", letters).lower()
            if low.isalpha() and "Σ" not in letters:
                return self._piece(low) + self._piece(word[len(letters) :]) if len(letters) < len(word) else self._piece(low)
        return self._whole(word)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        known, older = self.known, self.older
        for text in texts:
            out = []
            for word in text.split():
                ids = known.get(word)
                if ids is None:
                    ids = older.get(word)
                    if ids is None:
                        ids = self._encode(word.decode())
                    if len(word) <= 64:
                        known[word] = ids
                        if len(known) > CACHE_WORDS:  # words met since the last change of the two stay
                            self.older = older = known
                            self.known = known = {}
                out.append(ids)
            yield b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def pieces_task(path: str, capacity: int, end: int | None, keep_ids: bool):
    """For ``mapInArrow``: the pieces of each document's token ids, ``end`` appended, as they are packed."""
    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, None) or WordEncoder(path)
        _encoders[path] = encoder
        tail = b"" if end is None else pack("<I", end)
        for batch in batches:
            for part in parts(batch, limit=2 << 20):
                data, bounds = texts_of(part.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), list(unpack("<%dI" % (len(piece) // 4), piece)) if keep_ids else None))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, names.values())], schema=schema)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end: int | None = END, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)``: every document's tokens, cut only where it is over ``capacity``.

    A null text is empty, and so is one piece of the end token alone (none without ``end``).  Repeated rows give pieces
    each.  Other columns are not read.  Without ``keep_ids``, ``ids`` is null.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces_task(tokenizer_path, capacity, end, keep_ids), schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs ``(length, first rank, end rank, first sequence, offset)`` and the number of sequences.

    Pieces of a length with ranks from the first to before the end go, one each, to sequences from the first on.  Of all
    sequences a piece fits in, it takes one with the least room (best fit, longest first).
    """
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: heap of (first sequence, count)
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room <= 0 or not count:
            return
        if not free[room]:
            insort(rooms, room)
        heapq.heappush(free[room], (first, count))

    for length in sorted((x for x, n in counts.items() if n and x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = heapq.heappop(free[room])
                if not free[room]:
                    rooms.pop(at)
            else:
                # As many new sequences as the rest needs when each takes all it can.
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            used = min(count, left)
            runs.append((length, rank, rank + used, first, capacity - room))
            rank, left = rank + used, left - used
            put(room - length, first, used)
            put(room, first + used, count - used)
    return runs, opened


def rank_within(pieces: DataFrame, key: str, order: list[str], rank: str = "rank") -> tuple[DataFrame, DataFrame]:
    """The rows with ``rank`` from 0 within ``key``, and the written table ``(part, key, first, n, before)`` of the runs of
    one key in one partition: about one row per partition and key."""
    spark = pieces.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, part, first, n, before = unused(pieces, "place", "part", "first", "n", "before", also=[rank])
    ranged = pieces.repartitionByRange(n_parts, key, *order).sortWithinPartitions(key, *order)
    ranged = materialize(ranged.withColumn(place, F.monotonically_increasing_id()), "bestfit-ranged").withColumn(part, F.shiftright(place, 33))
    runs = ranged.groupBy(part, key).agg(F.min(place).alias(first), F.count("*").alias(n))
    ahead = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn(before, F.coalesce(F.sum(n).over(ahead), F.lit(0))), "bestfit-runs")
    # The ranges are sorted by key, so the runs are at most the partitions plus the distinct keys.
    joined = ranged.join(F.broadcast(runs.drop(n)), [part, key])
    joined = joined.withColumn(rank, F.col(place) - F.col(first) + F.col(before)).drop(place, part, first, before)
    return joined, runs.select(key, F.col(n).alias("n"))


def pack_best_fit(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``order`` names columns that break ties between pieces of one length.  Rows whose length is null, zero or over
    ``capacity`` get null places.  Repeated rows are pieces of their own.  Columns named as the new ones are replaced.  The rows are
    written to the shared folder, so give the columns you need and no texts.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    pieces = materialize(pieces, "bestfit-pieces")  # the ranges are sampled from it, so it must not be made twice
    rank, size, lo, hi, to = unused(pieces, "rank", "size", "lo", "hi", "to", also=["sequence_id", "offset"])
    fits = F.col("length").between(1, capacity)
    ranked, runs = rank_within(pieces.filter(fits), "length", order, rank)
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan, _ = plan_best_fit(counts, capacity)
    plan_table = spark.createDataFrame(plan, f"{size} int, {lo} long, {hi} long, {to} long, offset long")  # its size follows from the capacity
    here = (F.col("length") == F.col(size)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi))
    placed = ranked.join(F.broadcast(plan_table), here).withColumn("sequence_id", F.col(to) + F.col(rank) - F.col(lo)).drop(size, lo, hi, to, rank)
    return placed.unionByName(pieces.filter(~F.coalesce(fits, F.lit(False))), allowMissingColumns=True)
