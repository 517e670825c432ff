"""Removal of lines that many documents hold, decided on hashes and returned as bitmaps; DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code points
that at least ``min_docs`` documents hold lose all their lines except in the document with the largest id.

1. Keys become 128 bits of hash.  The rows (hash, document, position) are range partitioned by hash and a slice of the
   documents, so that a line of a third of all documents is spread over ``slices`` ranges, and sorted by document, largest
   first, and position.  In that order one pass streams the first occurrence of each key per document.
2. Slices are added up per hash; only hashes of enough documents go on.  They are joined back to the rows, those of very many
   lines spread over tasks.
3. Positions to drop become a compressed bitmap per document: 64-bit words of positions, those without a drop left out.

Text is read twice and shuffled once, when the bitmaps are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import unused
from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, row_key, pos, h1, h2)`` for every line whose key is long enough."""
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row_key", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    # A line shorter than the limit in bytes is so in code points.
    keyed = known.filter(F.octet_length("line") >= min_chars).select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_keys(lines: DataFrame, min_docs: int, slices: int) -> DataFrame:
    """``(h1, h2, keep_doc, n)``: the keys of at least ``min_docs`` documents, the largest document, and the number of lines."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_slice = ["h1", "h2", "slice"]
    ranged = lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"), "doc_id", "pos").repartitionByRange(parts, *by_slice)
    stream = Window.partitionBy(*by_slice).orderBy(F.desc("doc_id"), "pos")
    before = ranged.withColumn("before", F.lag("doc_id").over(stream))
    first = F.count_if(F.col("before").isNull() | (F.col("before") != F.col("doc_id")))
    counted = before.groupBy(*by_slice).agg(F.max("doc_id").alias("keep_doc"), first.alias("docs"), F.count("*").alias("n"))
    total = counted.groupBy("h1", "h2").agg(F.max("keep_doc").alias("keep_doc"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return total.filter(F.col("docs") >= min_docs).drop("docs")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slices: int = 256) -> DataFrame:
    """``(doc_id, row_key, n_dropped, words)``: for every document that loses lines, a map from ``pos div 64`` to a 64-bit
    word whose bit ``pos % 64`` is set when the line is dropped.  Documents and words that lose nothing are left out.

    ``docs`` has ``doc_id`` (whole number), ``row_key`` (a hash of the text, which keeps rows of one id apart) and ``text``.
    """
    lines = materialize(line_hashes(docs, min_chars), "lines")
    repeated = materialize(repeated_keys(lines, min_docs, slices), "lines-repeated")
    gone = join_by_heavy_key(lines, repeated.drop("n"), ["h1", "h2"], repeated).filter("doc_id <> keep_doc")
    bit = F.expr("shiftleft(1L, pos % 64)")
    # Rows repeated in the table have the same positions: a bit is set once, however often it is met.
    word = gone.groupBy("doc_id", "row_key", F.expr("CAST(pos div 64 AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    entries = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return word.groupBy("doc_id", "row_key").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), entries.alias("words"))


def dense_bitmap(words: Column) -> Column:
    """The bitmap's words from 0 to the last, so that a position is found without a search."""
    last = F.array_max(F.map_keys(words))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at(words, i), F.lit(0).cast("long")))


def apply_bitmap(text: Column, words: Column) -> Column:
    """The text without the dropped lines; unchanged where the bitmap is null."""

    def kept(bits: Column) -> Column:
        def stays(line: Column, pos: Column) -> Column:
            return F.coalesce(F.getbit(F.get(bits, F.shiftright(pos, 6)), pos.bitwiseAND(63)), F.lit(0)) == 0

        return F.array_join(F.filter(lines_of(text), stays), "\n")

    # The one-element array binds the dense bitmap, which is made once per row and not once per line.
    return F.when(words.isNull(), text).otherwise(F.get(F.transform(F.array(dense_bitmap(words)), kept), F.lit(0)))


def with_row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("row_key"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slices: int = 256) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, words)`` for every row of ``docs`` (``doc_id``, ``text``): keep bitmaps, no text.

    A null or empty text is one empty line.  A row without an id holds no line for others and loses none.  Rows of one id
    are one document.  Other columns are not read.
    """
    keyed = with_row_key(docs)
    found = drop_bitmaps(keyed, min_chars, min_docs, slices)
    counted = keyed.select("doc_id", "row_key", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    joined = counted.join(found, ["doc_id", "row_key"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "words")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, slices: int = 256) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; every other column as it is.  Cases as in ``line_dedup``."""
    found = drop_bitmaps(with_row_key(docs), min_chars, min_docs, slices)
    doc, row, words = unused(docs, "line_doc", "line_row", "line_words")
    found = found.select(F.col("doc_id").alias(doc), F.col("row_key").alias(row), F.col("words").alias(words))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(row))
    return docs.join(found, same, "left").withColumn("text", apply_bitmap(F.col("text"), F.col(words))).select(*docs.columns)
