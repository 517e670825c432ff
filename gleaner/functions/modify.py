"""Text modifiers: quotation and tag clean-up, Unicode repair, label prefix, chat turns."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.encoding import repair_encoding
from gleaner.functions.slices import by_slices
from gleaner.functions.text import strip

# The quotation marks to unify, and the tag and URL pattern to delete ([$-_] is a range, which has % in it).
# One class of characters and not a repeated group: Java takes a stack frame for every turn of such a group, and a URL of
# 2,000 characters would end the JVM.
QUOTES = ("‘’“”\t", "''\"\" ")
TAG_OR_URL = r"(<[^>]+>)|(http[s]?://[a-zA-Z0-9$-_@.&+!*\(\),]+)"

# The chat turn marks.
USER_OPEN = "<start_of_turn>user\n"
MODEL_OPEN = "<start_of_turn>model\n"
TURN_CLOSE = "<end_of_turn>"


def unify_quotes_and_tags(text: Column) -> Column:
    """Straight quotes, tab to one space, then delete tags and URLs.  Runs of spaces and e-mails stay."""
    return F.regexp_replace(F.translate(text, *QUOTES), TAG_OR_URL, "")


def label_prefix(label: str):
    """Modifier that puts a label in front and keeps the sample on one line."""
    return lambda text: F.concat(F.lit(f"{label} "), F.regexp_replace(text, "[\r\n]+", " "))


def user_turn(prompt: Column) -> Column:
    return F.concat(F.lit(USER_OPEN), strip(prompt), F.lit(f"{TURN_CLOSE}\n{MODEL_OPEN}"))


def chat_turns(prompt: Column, label: Column) -> Column:
    return F.concat(user_turn(prompt), strip(label), F.lit(TURN_CLOSE))


# Typographic ligatures, and characters that are taken out.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_DROP = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufeff\ufffe\uffff]")
_LINE_BREAKS = re.compile("\r\n|[\r\x85\u2028\u2029]")
_ENTITY = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_WIDE = re.compile("[\uff01-\uff5e\u3000\uffe0-\uffe6]")

_LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")


def reformat_text(text: str) -> str:
    """Entities, wrongly decoded text, ligatures, full-width forms, line breaks, control characters, NFC."""
    if "&" in text and "<" not in text:  # with tags present the text is markup, where entities belong
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if text.isascii():
        return _DROP.sub("", _LINE_BREAKS.sub("\n", text))
    text = _LIGATURE.sub(lambda m: LIGATURES[m.group()], repair_encoding(text))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return unicodedata.normalize("NFC", _DROP.sub("", _LINE_BREAKS.sub("\n", text)))


def reformat_unicode(text: Column) -> Column:
    """Repair encoding damage and put the text into one normal form."""

    def reformatted(texts: list[str | None]) -> pa.Array:
        return pa.array([None if t is None else reformat_text(t) for t in texts], pa.string())

    return by_slices(reformatted, "string")(text)
