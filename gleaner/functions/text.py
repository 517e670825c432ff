"""Column expressions over text that every filter and modifier shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space as Python's str.split knows it; Java's \\s alone is ASCII, and its Unicode form leaves
# out the four information separators.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE = r"(?U:[\s\x1c-\x1f])"
ASCII_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` knows spaces only)."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def words(text: Column) -> Column:
    """Pieces between runs of white space; none in a blank text."""
    inner = strip(text)
    # A text of single-byte characters needs no Unicode look-up per character.
    ascii_only = F.octet_length(text) == F.length(text)
    pieces = F.when(ascii_only, F.split(inner, ASCII_SPACE + "+")).otherwise(F.split(inner, SPACE + "+"))
    return F.when(inner != "", pieces).otherwise(F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: ~is_blank(s))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.filter(F.split(text, f"\n{SPACE}*\n"), lambda s: ~is_blank(s))


# Marks that end a sentence where white space and no small letter follow; marks that end one anywhere; what
# may close after a mark; abbreviations of titles, references and months, whose full stop ends no sentence.
OPEN_STOPS = ".!?…"
FULL_STOPS = "।॥。！？"
CLOSERS = r"\"”’»)\]"
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "Gen", "Col", "Lt", "Capt", "Sgt", "Rev", "Hon", "Gov", "Sen", "Rep",
    "vs", "cf", "ca", "approx", r"e\.g", r"i\.e", "Fig", "Figs", "Eq", "Vol", "Ch", "pp", "Jan", "Feb", "Mar", "Apr", "Aug",
    "Sept", "Oct", "Nov", "Dec", "डॉ", "प्रो", "पं", "श्री", "कु",
]
# An abbreviation, or up to ten initials, with its full stop; looked for only at a full stop.
_ABBREVIATED = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}])(?:{'|'.join(ABBREVIATIONS)}|(?:\p{{Lu}}\.){{0,9}}\p{{Lu}})\."
_FULL_END = f"[{FULL_STOPS}][{CLOSERS}]*"
_OPEN_END = rf"[{OPEN_STOPS}](?=[{CLOSERS}]*{SPACE}+[^\p{{Ll}}{OPEN_STOPS}\s])(?<!{_ABBREVIATED})[{CLOSERS}]*"


def sentences(text: Column) -> Column:
    """The sentences of a text as they stand, without the white space between them; none in a blank text.

    A sentence ends with its line, after a danda or a wide full stop, and after ``. ! ? …`` where white space follows and then
    neither a small letter nor another mark.  Quotation marks and brackets that close belong to it.  The full stop of
    an abbreviation or an initial ends none, so a sentence that ends in one runs on.
    """
    pieces = F.split(F.regexp_replace(text, f"{_FULL_END}|{_OPEN_END}", "$0\n"), "\n")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def line_ends(text: Column) -> Column:
    """The last three characters of each line that are not trailing white space."""
    return F.transform(lines(text), lambda s: F.right(F.rtrim(s, F.lit(SPACES)), F.lit(3)))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return gone if len(literal) == 1 else (gone / len(literal)).cast("int")


def total_length(pieces: Column) -> Column:
    """Characters in all strings of an array."""
    return F.length(F.array_join(pieces, ""))


def matched_chars(text: Column, pattern: str) -> Column:
    """Characters covered by the matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) fixed by seed and key, so it does not depend on partitioning as ``rand`` does."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """A full-width key for a reproducible shuffle."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters may use freely without the expression being copied into each use.

    The optimizer merges projections and pushes predicates through them, which would repeat a costly
    ``split`` per use.  It does neither through a generator, and ``inline`` of a one-element array of
    structs is a generator that keeps the row count.
    """
    if not columns:
        return df
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
