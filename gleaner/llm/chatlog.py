"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``message`` (the message with its text), ``delta`` (more text), ``edit`` (another text in place of
the old), ``regenerate`` (the text so far goes, deltas follow), ``delete``.  The log is partitioned by ranges of conversation and
message and sorted within; a task folds the events of one message after the other in order of their sequence number, renders
the final ones, and returns each conversation as one row, or as several parts where it is long or crosses into
another partition.  So a conversation that holds a third of all events is spread over as many tasks as its share asks for, and a
task holds one message and one part.

A template marks the turns.  Control strings inside a text get a backslash behind their first character, behind those
that are there already, which reading takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

EVENTS = ("message", "delta", "edit", "regenerate", "delete")
PART_CHARS = 1 << 16


@dataclass(frozen=True)
class Template:
    """``begin``, the role, a line end, the text, ``end``.  ``controls`` are the strings that a text must not hold."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self) -> None:
        marks = (self.begin, self.end)
        if any(len(c) < 2 or c[1] == "\\" for c in self.controls):
            raise ValueError("a control string has at least two characters, the second no backslash")
        if not all(any(m.startswith(c) for c in self.controls) for m in marks):
            raise ValueError("a mark must begin with a control string")
        for a in self.controls:
            for b in self.controls:
                if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))):
                    raise ValueError(f"{b!r} may begin within {a!r}, which could not be read back")

    @cached_property
    def _starts(self) -> dict[str, str]:
        """Per first character, a pattern of what follows it in a control string that may hold backslashes there."""
        starts: dict[str, list[str]] = {}
        for c in self.controls:
            starts.setdefault(c[0], []).append(re.escape(c[1:]))
        return {first: rf"(?=\\*(?:{'|'.join(rest)}))" for first, rest in starts.items()}

    @cached_property
    def _plain(self) -> re.Pattern:
        return re.compile("|".join(re.escape(first) + rest for first, rest in self._starts.items()))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile("|".join(rf"{re.escape(first)}\\{rest}" for first, rest in self._starts.items()))

    def escape(self, text: str) -> str:
        if not any(first in text for first in self._starts):
            return text
        return self._plain.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        # The first backslash of a run goes, the others stay.
        return self._escaped.sub(lambda m: m[0][:-1], text)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A formatted turn, and where the text begins and ends in it."""
        head = f"{self.begin}{self.escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
        inner = self.escape(text)
        return f"{head}{inner}{self.end}", len(head), len(head) + len(inner)

    def parse(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of every turn."""
        at = 0
        while at < len(formatted):
            line = formatted.index("\n", at)
            stop = formatted.index(self.end, line + 1)
            name = self.unescape(formatted[at + len(self.begin) : line])
            yield re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name), self.unescape(formatted[line + 1 : stop])
            at = stop + len(self.end)


def fold(events: Iterator[tuple[str | None, str | None, str | None]]) -> tuple[str, str] | None:
    """Role and text of a message after its events ``(event, role, text)``; None if it was deleted or never had one.

    The role is the first that is given, else empty; a null text is empty, a null event is none.  Deltas after a deletion begin
    the message anew.
    """
    role, pieces = None, None
    for event, said_by, text in events:
        if event is None:
            continue
        if event not in EVENTS:
            raise ValueError(f"unknown event {event!r}")
        role = said_by if role is None else role
        if event == "delete":
            pieces = None
        elif event == "regenerate":
            pieces = []
        elif event == "delta" and pieces is not None:
            pieces.append(text or "")
        else:
            pieces = [text or ""]
    return None if pieces is None else (role or "", "".join(pieces))


PARTS = "conv_id long, part long, whole boolean, n_turns long, formatted string, loss array<struct<begin:int,end:int>>"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])


def format_task(template: Template, trained: str, n_keys: int, part_chars: int):
    """For ``mapInArrow``: sorted events, as conversation, ``n_keys`` names of the message, event, role, text, to parts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*parts), _PARTS)], schema=_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts are in order within a partition, and partitions in order of their number.
        number = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        last: tuple | None = None  # the last part of a conversation, till it is known whether another one follows
        for nth, (conv, events) in enumerate(groupby(rows(batches), key=lambda r: r[0])):
            if last is not None:
                out.append(last)
                last = None
            whole = nth > 0  # the first may have begun in the partition before
            turns, pieces, spans, length = 0, [], [], 0
            for _, message in groupby(events, key=lambda r: r[1 : 1 + n_keys]):
                final = fold(r[1 + n_keys :] for r in message)
                if final is None:
                    continue
                text, begin, end = template.render(*final)
                if length and length + len(text) > part_chars:
                    whole = False
                    out.append((conv, number, whole, turns, "".join(pieces), spans))
                    number, turns, pieces, spans, length = number + 1, 0, [], [], 0
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
                if final[0] == trained:
                    spans.append({"begin": length + begin, "end": length + end})
                pieces.append(text)
                turns, length = turns + 1, length + len(text)
            if turns:
                last = (conv, number, whole, turns, "".join(pieces), spans)
                number += 1
            if len(out) >= 64:
                yield batch_of(out)
                out = []
        if last is not None:
            out.append((*last[:2], False, *last[3:]))  # it may go on in the partition behind
        if out:
            yield batch_of(out)

    return run


def format_conversations(
    log: DataFrame,
    message: Sequence[str] = ("turn",),
    sequence: str = "seq",
    conversation: str = "conv_id",
    event: str = "event",
    role: str = "role",
    text: str = "text",
    template: Template = Template(),
    trained: str = "assistant",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``(conv_id, part, whole, n_turns, formatted, loss)``: every conversation of the log, rendered.

    ``message`` are the columns that name a message within its conversation and order the messages; events of one message
    are folded in the order of ``sequence``.  ``whole`` says that the row is all of its conversation; else its rows follow
    each other by ``part``, and all those of a conversation have ``whole`` false.  ``loss`` are the places in
    ``formatted``, in code points and half open, of the texts of the role ``trained``.

    Nulls: a null text is empty, a null role is the empty role, a null event is none, a null conversation is one of
    its own, null message names come first.  Events that are equal in conversation, message and sequence are folded one
    after the other in any order.  A conversation whose messages are all deleted has no row, an empty log none.  A very long
    message is a part by itself.  Other columns are not read.
    """
    names = list(message)
    columns = [F.col(conversation).cast("long").alias("conv"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(names))]
    events = log.select(*columns, F.col(sequence).alias("seq"), F.col(event).alias("event"), F.col(role).alias("role"), F.col(text).alias("text"))
    keys = ["conv", *(f"m{i}" for i in range(len(names)))]
    ordered = events.repartitionByRange(*keys).sortWithinPartitions(*keys, "seq").select(*keys, "event", "role", "text")
    return ordered.mapInArrow(format_task(template, trained, len(names), part_chars), PARTS)


class Digest:
    """A conversation read back from its parts, in order, without holding more than one."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss_chars, self.chars = template, 0, 0, 0
        self.said, self.lost = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in self.template.parse(formatted):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = self.template.unescape(formatted[span["begin"] : span["end"]])
            self.loss_chars += len(text)
            self.lost.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def digest_task(template: Template):
    """For ``mapInArrow``: digests of whole conversations; parts of others are handed on as they are."""
    schema = pa.schema([*_DIGESTS, ("rest", pa.struct(list(_PARTS)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["whole"]:
                    digest = Digest(template)
                    digest.add(row["formatted"], row["loss"])
                    out.append((row["conv_id"], *digest.row(), None))
                else:
                    out.append((row["conv_id"], *[None] * 5, row))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def digest_parts_task(template: Template):
    """For ``mapInArrow``: digests of conversations whose parts come one after the other, in order."""
    schema = pa.schema(_DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for conv, parts in groupby(rows, key=lambda r: r["conv_id"]):
            digest = Digest(template)
            for part in parts:
                digest.add(part["formatted"], part["loss"])
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((conv, *digest.row()), schema)], schema=schema)

    return run


def conversation_digests(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Of every conversation of ``format_conversations``, read back from its output: turns, sha256 of role and text of
    each with a line end after both, code points and sha256 of all text under the loss mask, code points of the output.

    Whole conversations are read where they are.  Only the parts of others move, and are read one after the other: a
    digest is sequential, but holds one part at a time.
    """
    read = parts.mapInArrow(digest_task(template), f"{DIGESTS}, rest struct<{PARTS}>")
    read = materialize(read, "chat-digests")
    columns = [c for c in read.columns if c != "rest"]
    rest = read.filter("rest IS NOT NULL").select("rest.*").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return read.filter("rest IS NULL").select(*columns).unionByName(rest.mapInArrow(digest_parts_task(template), DIGESTS))


def log_of_conversations(conversations: DataFrame, delta_chars: int = 512) -> DataFrame:
    """An event log of a table of final messages (``conv_id``, ``turn``, ``role``, ``text``), as a chat service would have kept it.

    Assistant messages were streamed in deltas; for a third of them a first attempt was broken off and regenerated.  The
    others came whole; a third of them was edited after a first draft.  Rows of one turn are messages of their own, in the order of
    a hash of role and text (``message``), equal ones in any order (``copy``).
    """
    text = F.coalesce("text", F.lit(""))
    draft = F.crc32(F.concat_ws(":", "conv_id", "turn")) % 3 == 0

    def event(kind: str, said) -> F.Column:
        return F.struct(F.lit(kind).alias("event"), said.alias("text"))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % delta_chars), F.lit(0))
    start = F.when(draft, F.array(event("message", F.lit("")), event("delta", F.lit("Let me")), event("regenerate", F.lit("")))).otherwise(F.array(event("message", F.lit(""))))
    streamed = F.concat(start, F.transform(pieces, lambda p: event("delta", p)))
    typed = F.when(draft, F.array(event("message", F.lit("draft")), event("edit", text))).otherwise(F.array(event("message", text)))
    named = conversations.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("message"), F.monotonically_increasing_id().alias("copy"), "role",
        F.when(F.col("role") == "assistant", streamed).otherwise(typed).alias("events"),
    )
    return named.select("conv_id", "turn", "message", "copy", "role", F.posexplode("events").alias("seq", "said")).select(
        "conv_id", "turn", "message", "copy", "seq", "role", F.col("said.event").alias("event"), F.col("said.text").alias("text")
    )
