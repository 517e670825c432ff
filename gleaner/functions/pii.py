"""Personal data: find the spans of an entity type and replace them.

There is one rule: of spans that overlap, the one with the higher score stays, then the longer, then the earlier.  A single
type that is a pattern alone has no overlaps and is replaced inside the engine; all else goes through an Arrow UDF, which
also gives the spans.  Persons and places are found from word lists of any length (``gazetteer.py``), addresses by a
pattern and a list of street words; a list finds less than a language model does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.charmodel import runs
from gleaner.functions.gazetteer import TOKEN, Gazetteer
from gleaner.functions.slices import by_slices

SPANS = "array<struct<type string, start int, end int, score double>>"
ARROW_SPANS = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

# Entity types, patterns and scores.  The patterns are written so that
# Java, Python and RE2 read them alike.  Groups repeat a bounded number of times (a host has at most 127 labels), since
# Java takes a stack frame for every turn.
PATTERNS: dict[str, tuple[str, float]] = {
    "EMAIL_ADDRESS": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}\b", 1.0),
    "URL": (r"\b(?:https?://|www\.)[^\s<>]+", 0.95),
    "CREDIT_CARD": (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}\b", 1.0),
    "IP_ADDRESS": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b",
        0.95,
    ),
    "US_SSN": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    "PHONE_NUMBER": (r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", 0.75),
    "DATE_TIME": (
        r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
        r"|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\b",
        0.6,
    ),
    "US_PASSPORT": (r"\b[A-Z][0-9]{8}\b", 0.4),
    "US_DRIVER_LICENSE": (r"\b[A-Z][0-9]{7}\b", 0.3),
}

# The default word lists.
GIVEN_NAMES = [
    "Aisha", "Alice", "Ana", "Anna", "Anil", "Antonio", "Carlos", "Charles", "Claire", "Dana", "Daniel", "David",
    "Deepak", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Hans", "Isabel", "James", "Jean", "Jennifer", "John",
    "José", "Juan", "Karen", "Laura", "Linda", "Luis", "Maria", "María", "Marie", "Mary", "Michael", "Mohammed",
    "Patricia", "Paul", "Pedro", "Peter", "Pierre", "Priya", "Rahul", "Ravi", "Robert", "Ryan", "Sarah", "Sofia",
    "Sunita", "Suresh", "Susan", "Thomas", "William", "सुरेश", "राम", "सीता", "अनीता",
]
PLACES = [
    "Berlin", "Chicago", "Delhi", "Dubai", "England", "France", "Germany", "India", "London", "Madrid", "Mexico",
    "Mumbai", "New York", "Paris", "Rome", "Spain", "Tokyo", "Toronto", "दिल्ली", "मुंबई", "भारत",
]
STREETS = ["Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Square"]

ENTITIES = [*PATTERNS, "PERSON", "LOCATION", "ADDRESS"]


LIST_SCORE = 0.85
LISTED = ("PERSON", "LOCATION")

# Family names that may follow a given name in Hindi text.
FAMILY_NAMES = ("कुमार", "सिंह", "शर्मा", "देवी")
_SECOND = re.compile("(?:[A-Z][a-z]+|" + "|".join(FAMILY_NAMES) + r")")


@dataclass(frozen=True)
class Lexicon:
    """The word lists for entity types that have no pattern.

    ``table`` takes the place of ``given_names`` and ``places``; ``Lexicon.from_table`` makes it of a list of any length.
    """

    given_names: tuple[str, ...] = field(default=tuple(GIVEN_NAMES))
    places: tuple[str, ...] = field(default=tuple(PLACES))
    streets: tuple[str, ...] = field(default=tuple(STREETS))
    table: Broadcast | None = None

    @classmethod
    def from_table(cls, df: DataFrame, phrase: str = "phrase", kind: str = "kind", **settings) -> Lexicon:
        """From a table of phrases with the kind PERSON or LOCATION; see ``Gazetteer.from_table``."""
        return cls(table=df.sparkSession.sparkContext.broadcast(Gazetteer.from_table(df, phrase, kind, LISTED, **settings)))

    def gazetteer(self) -> Gazetteer:
        return _small(self.given_names, self.places) if self.table is None else self.table.value

    def address(self) -> tuple[str, float]:
        words = "|".join(sorted(map(re.escape, self.streets), key=lambda w: (-len(w), w)))
        return rf"\b[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{words})\b", 0.6


@cache
def _small(given_names: tuple[str, ...], places: tuple[str, ...]) -> Gazetteer:
    return Gazetteer.of({"PERSON": given_names, "LOCATION": places})


def _chosen(entities: Sequence[str] | None) -> list[str]:
    unknown = set(entities or []) - set(ENTITIES)
    if unknown:
        raise ValueError(f"unknown entity types {sorted(unknown)}")
    return [name for name in ENTITIES if entities is None or name in entities]


def luhn_ok(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


# The characters of an address before the sign, and the rest of its pattern.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}\b")
_EDGE = re.compile(r"\b")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern EMAIL_ADDRESS finds, from the sign outwards: a long run without one takes no time.

    The local part begins at the first word edge of its run, as a search from the left would have it.
    """
    free = 0  # the end of the address before
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain is not None and at >= free:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            edge = _EDGE.search(text, start, at)
            if edge is not None and edge.start() < at:
                yield edge.start(), domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _compile(chosen: Sequence[str], lexicon: Lexicon) -> dict[str, tuple[Callable, float]]:
    """A finder of places, and the score, per type that is no list."""
    finders = {}
    for name, (pattern, score) in {**PATTERNS, "ADDRESS": lexicon.address()}.items():
        if name in chosen:
            # Word edges follow Unicode, white space in a URL is ASCII as in the engine's own pattern language.
            finders[name] = (_matches(re.compile(pattern.replace(r"[^\s<>]", r"[^ \t\n\x0b\f\r<>]"))), score)
    if "EMAIL_ADDRESS" in finders:
        finders["EMAIL_ADDRESS"] = (emails, finders["EMAIL_ADDRESS"][1])
    if "CREDIT_CARD" in finders:
        digits, score = finders["CREDIT_CARD"]
        finders["CREDIT_CARD"] = (lambda text: ((a, b) for a, b in digits(text) if luhn_ok(text[a:b])), score)
    return finders


def listed_spans(texts: Sequence[str], chosen: Sequence[str], gazetteer: Gazetteer) -> list[list[tuple[str, int, int, float]]]:
    """Names and places of each text: of one type the leftmost, then the longest, none overlapping.

    A name takes one capitalised word, or Hindi family name, that follows it after a blank as its second part.
    """
    out = []
    for text, found in zip(texts, gazetteer.find(texts)):
        spans, free = [], {}
        for kind, begin, end, _ in found:
            if kind in chosen and begin >= free.get(kind, 0):
                if kind == "PERSON" and text[end : end + 1] == " " and (word := TOKEN.match(text, end + 1)) and _SECOND.fullmatch(word[0]):
                    end = word.end()
                free[kind] = end
                spans.append((kind, begin, end, LIST_SCORE))
        out.append(spans)
    return out


def find_spans(text: str, finders: Mapping[str, tuple[Callable, float]], more: Sequence[tuple[str, int, int, float]] = ()) -> list[tuple[str, int, int, float]]:
    """Non-overlapping spans in text order, 0-based and half open, in code points.

    Of spans that overlap, the one with the higher score stays, then the longer, then the earlier; of equal places the type whose
    name comes first.  ``more`` are spans found otherwise.
    """
    found = [(-score, start - end, start, end, name) for name, (finder, score) in finders.items() for start, end in finder(text)]
    found += [(-score, start - end, start, end, name) for name, start, end, score in more]
    taken, spans = bytearray(len(text)), []
    for score, _, start, end, name in sorted(found):
        if 1 not in taken[start:end]:
            taken[start:end] = b"\1" * (end - start)
            spans.append((name, start, end, -score))
    return sorted(spans, key=lambda s: s[1])


def all_spans(texts: Sequence[str], chosen: Sequence[str], lexicon: Lexicon) -> Iterator[list[tuple[str, int, int, float]]]:
    finders = _compile(chosen, lexicon)
    for run in runs(texts):
        listed = listed_spans(run, chosen, lexicon.gazetteer()) if set(LISTED) & set(chosen) else [()] * len(run)
        for text, more in zip(run, listed):
            yield find_spans(text, finders, more)


def analyze(text: Column, entities: Sequence[str] | None = None, lexicon: Lexicon = Lexicon()) -> Column:
    """Array of spans in text order; null for a null text."""
    chosen = _chosen(entities)

    def spans(texts: list[str | None]) -> pa.Array:
        found = all_spans([t or "" for t in texts], chosen, lexicon)
        rows = [None if t is None else [dict(zip(("type", "start", "end", "score"), s)) for s in row] for t, row in zip(texts, found)]
        return pa.array(rows, ARROW_SPANS)

    return by_slices(spans, SPANS)(text)


def _java(pattern: str) -> str:
    # Word characters and edges by Unicode, white space by ASCII, as in the Python form.
    return "(?U)" + pattern.replace(r"[^\s<>]", r"[^ \t\n\x0b\f\r<>]")


def redact(
    text: Column,
    entities: Sequence[str] | None = None,
    anonymize_action: str = "replace",
    lexicon: Lexicon = Lexicon(),
) -> Column:
    """Replace every span by ``<TYPE>``; null for a null text."""
    if anonymize_action != "replace":
        raise ValueError("replace is the only action")
    chosen = _chosen(entities)
    if len(chosen) == 1 and chosen[0] in set(PATTERNS) - {"CREDIT_CARD", "EMAIL_ADDRESS"}:  # a pattern, and nothing to overlap
        return F.regexp_replace(text, _java(PATTERNS[chosen[0]][0]), f"<{chosen[0]}>")

    def spliced(texts: list[str | None]) -> pa.Array:
        def splice(t: str, found: list[tuple[str, int, int, float]]) -> str:
            parts, at = [], 0
            for name, start, end, _ in found:
                parts += [t[at:start], f"<{name}>"]
                at = end
            return "".join([*parts, t[at:]])

        found = all_spans([t or "" for t in texts], chosen, lexicon)
        return pa.array([None if t is None else splice(t, spans) for t, spans in zip(texts, found)], pa.string())

    return by_slices(spliced, "string")(text)


def pii_redactor(entities: Sequence[str] | None = None, lexicon: Lexicon = Lexicon()):
    """The redaction as a modifier for ``Modify``."""
    return lambda text: redact(text, entities, lexicon=lexicon)
