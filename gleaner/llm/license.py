"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates the
expressions behind the tags.

Texts are searched in their normal form: words of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased, with
one space before, between and after.  A phrase is its words with spaces at both ends, so it is found only at whole words,
and the number of a word is the number of spaces before it.  An identifier tag is followed, in the text as it is written,
by an expression such as ``(MIT OR Apache-2.0) AND BSD-3-Clause`` up to the end of the line.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import parts, texts_of

#: The phrases asked for, with their labels.
BASE_PHRASES: Mapping[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notice phrases beyond those, with their labels.
NOTICE_PHRASES: Mapping[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "licensed under the apache license": "apache-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "sil open font license": "ofl",
    "open data commons open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "do what the fuck you want to public license": "wtfpl",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
}

#: Words that introduce an expression, in normal form.
TAGS = ("spdx license identifier", "spdx licence identifier")
TAG = re.compile(rb"spdx-licen[sc]e-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)

# Names of the SPDX list.  Families and their versions; after a version may stand -only or -or-later, or, as
# older lists had it, + or nothing.
FAMILIES: Mapping[str, tuple[str, ...]] = {
    "gpl": ("1.0", "2.0", "3.0"),
    "lgpl": ("2.0", "2.1", "3.0"),
    "agpl": ("1.0", "3.0"),
    "gfdl": ("1.1", "1.2", "1.3"),
}
CREATIVE_COMMONS = ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")
CREATIVE_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
PERMISSIVE = (
    "0bsd afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent"
    " bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc0-1.0 curl ecl-2.0 fsfap ftl hpnd icu ijg isc json libpng mit mit-0 ms-pl"
    " mulanpsl-2.0 ncsa ntp openssl php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016 unlicense"
    " upl-1.0 vim w3c wtfpl x11 zlib zpl-2.0 zpl-2.1"
).split()
RESTRICTED = (
    "apsl-2.0 busl-1.1 cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ipl-1.0 mpl-1.0 mpl-1.1 mpl-2.0 ms-rl"
    " odbl-1.0 ofl-1.0 ofl-1.1 osl-3.0 qpl-1.0 sspl-1.0"
).split()
#: Labels that keep part of the number or more; of the other names the version goes.
KEPT_LABELS = {"apache-1.0": "apache-1", "apache-1.1": "apache-1", "apache-2.0": "apache-2"}


def _identifiers() -> dict[str, tuple[str, bool]]:
    """Label and whether the terms are permissive, per name in lower case."""
    version = re.compile(r"-[0-9]+(\.[0-9]+)+$")
    out = {name: (KEPT_LABELS.get(name, version.sub("", name)), permissive) for names, permissive in ((PERMISSIVE, True), (RESTRICTED, False)) for name in names}
    out |= {f"{kind}-{v}": (kind, kind == "cc-by") for kind in CREATIVE_COMMONS for v in CREATIVE_COMMONS_VERSIONS}
    out |= {f"{family}-{v}{ending}": (family, False) for family, versions in FAMILIES.items() for v in versions for ending in ("", "-only", "-or-later")}
    return out


IDENTIFIERS: Mapping[str, tuple[str, bool]] = _identifiers()

_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


class Terms(NamedTuple):
    """Value of an expression, which offers one or more ways to choose among its licences.

    ``labels``: all that are named, exceptions included.  ``obligations``: the licences of every way.  ``chosen``: those of the
    best way, which is permissive if any is, then of known names if any is, then of few licences.  ``permissive``, ``known``:
    whether some way has only permissive licences, or only known names.
    """

    labels: frozenset[str]
    obligations: frozenset[str]
    chosen: frozenset[str]
    exceptions: frozenset[str]
    permissive: bool
    known: bool

    @property
    def choice(self) -> frozenset[str]:
        """The licences of some ways but not of all."""
        return self.labels - self.obligations - self.exceptions

    @property
    def verdict(self) -> str:
        return "permissive" if self.permissive else "restricted" if self.known else "unknown"

    def rank(self) -> tuple:
        return not self.permissive, not self.known, len(self.chosen), sorted(self.chosen)


def both(a: Terms, b: Terms) -> Terms:
    return Terms(a.labels | b.labels, a.obligations | b.obligations, a.chosen | b.chosen, a.exceptions | b.exceptions, a.permissive and b.permissive, a.known and b.known)


def either(a: Terms, b: Terms) -> Terms:
    best = min(a, b, key=Terms.rank)
    return Terms(a.labels | b.labels, a.obligations & b.obligations, best.chosen, a.exceptions | b.exceptions, a.permissive or b.permissive, a.known or b.known)


def to_postfix(expression: str) -> list[str] | None:
    """Dijkstra's shunting yard: names and operators in postfix order, the longest well-formed beginning of the text.

    ``with`` binds more closely than ``and``, and that more than ``or``; case is ignored.  None if nothing is well formed.
    """
    tokens: list[str] = []
    open_at: list[int] = []
    good = 0  # tokens that make a whole expression
    operand_next = True
    at = 0
    while at < len(expression):
        found = _TOKEN.match(expression, at)
        if not found:
            if not expression[at].isspace():
                break
            at += 1
            continue
        token = found[0].lower()
        if token == "(":
            if not operand_next:
                break
            open_at.append(len(tokens))
        elif token == ")":
            if operand_next or not open_at:
                break
            open_at.pop()
        elif token in _BINDING:
            if operand_next:
                break
            operand_next = True
        elif operand_next:
            operand_next = False
        else:
            break
        tokens.append(token)
        at = found.end()
        if not operand_next and not open_at:
            good = len(tokens)
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens[:good]:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in _BINDING:
            while waiting and waiting[-1] != "(" and _BINDING[waiting[-1]] >= _BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    out += reversed(waiting)
    return out or None


def term_of(name: str, identifiers: Mapping[str, tuple[str, bool]]) -> Terms:
    """Value of a name in lower case; ``+`` behind a name is the same licence in a later version."""
    if name not in identifiers:
        name = name.rstrip(".:")
        name = name.removesuffix("+") if name.removesuffix("+") in identifiers else name
    label, permissive = identifiers.get(name, (name, False))
    one = frozenset([label])
    return Terms(one, one, one, frozenset(), permissive, name in identifiers)


def evaluate(expression: str, identifiers: Mapping[str, tuple[str, bool]] = IDENTIFIERS) -> Terms | None:
    """Value of an expression: ``or`` offers the ways of either side, ``and`` joins one of each, ``with`` adds an exception to
    the licence on its left.  None if the text is no expression."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[Terms, str]] = []
    for token in postfix:
        if token not in _BINDING:
            stack.append((term_of(token, identifiers), token))
            continue
        (right, name), (left, _) = stack.pop(), stack.pop()
        if token == "with":
            exceptions = right.labels if name in _BINDING else frozenset([name.rstrip(".:")])
            value = left._replace(labels=left.labels | exceptions, exceptions=left.exceptions | exceptions)
        else:
            value = both(left, right) if token == "and" else either(left, right)
        stack.append((value, token))
    return stack[0][0]


#: Scores of a tag by its verdict.
VERDICT_SCORES = {"permissive": 1.0, "restricted": 0.95, "unknown": 0.6}

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


class Scanner:
    def __init__(self, base: Mapping[str, str], notices: Mapping[str, str], identifiers: Mapping[str, tuple[str, bool]]):
        import ahocorasick

        self.identifiers = identifiers
        # One entry per phrase: number of words, base label, notice label, whether it is a tag.
        entries: dict[str, list] = {}
        for phrases, place in ((base, 1), (notices, 2)):
            for phrase, label in phrases.items():
                entries.setdefault(phrase, [len(phrase.split()), None, None, False])[place] = label
        for tag in TAGS:
            entries.setdefault(tag, [len(tag.split()), None, None, False])[3] = True
        # Bytes as characters 0 to 255, so that the automaton works on bytes.
        self.automaton = ahocorasick.Automaton()
        for phrase, entry in entries.items():
            self.automaton.add_word(f" {phrase} ", tuple(entry))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        """The values of ``SCANNED``.  Expressions of several tags hold together, as if joined by ``and``."""
        words = raw.translate(_WORD_BYTES).split()
        normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
        n_base, first, last, base_labels, labels, tagged = 0, None, None, set(), set(), False
        score, counted, spaces = 0.0, 0, 0
        for end, (size, base, notice, tag) in self.automaton.iter(normal):
            # Hits come by their ends, so the spaces before are counted on from the hit before.
            spaces += normal.count(" ", counted, end)
            counted = end
            if base is not None:
                word = spaces - size
                n_base += 1
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
                base_labels.add(base)
                score = max(score, 0.9)
            if notice is not None:
                labels.add(notice)
                score = max(score, 0.7)
            tagged |= tag
        expressions, terms = [], None
        if tagged:
            for found in TAG.finditer(raw):
                text = found[1].decode("utf-8", "replace").strip()
                value = evaluate(text, self.identifiers)
                if value is not None:
                    expressions.append(text)
                    terms = value if terms is None else both(terms, value)
                    score = max(score, VERDICT_SCORES[value.verdict])
        told = [None] * 5
        if terms is not None:
            labels |= terms.labels
            told = [terms.verdict, *(",".join(sorted(x)) for x in (terms.obligations, terms.choice, terms.chosen, terms.exceptions))]
        labels |= base_labels
        return len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions, *told


TOLD = ("verdict", "obligations", "choice", "chosen", "exceptions")
SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, " + ", ".join(f"{c} string" for c in TOLD)


def scan_licenses(
    docs: DataFrame,
    base: Mapping[str, str] = BASE_PHRASES,
    notices: Mapping[str, str] = NOTICE_PHRASES,
    identifiers: Mapping[str, tuple[str, bool]] = IDENTIFIERS,
    out: str = "license",
) -> DataFrame:
    """``docs`` with a struct column ``out``: places and labels of the base phrases, all labels, a score, the expressions of the
    tags and what they come to.

    ``verdict`` is permissive, restricted or unknown; ``obligations`` are the licences that hold whatever is chosen,
    ``choice`` those that may be chosen or not, ``chosen`` those of the best choice, ``exceptions`` what follows ``with``.  All
    five are null without an expression.  The score is the largest of 1, 0.95 or 0.6 by the verdict of each tag, 0.9 with a base phrase,
    0.7 with a notice, else 0.  A null text is empty: no words, no places, empty labels.  Rows stay as they are, repeated ones too.
    A column of ``docs`` named ``out`` is replaced; name another one to keep it.
    """

    def run(column: pa.Array) -> pa.Array:
        scanner = _scanner(base, notices, identifiers)
        chunks = []
        for part in parts(pa.record_batch([column], ["text"])):
            data, bounds = texts_of(part.column("text"))
            raw = data.tobytes()
            rows = [scanner.scan(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            chunks.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], [f.name for f in ARROW]))
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.struct(list(ARROW)))

    return docs.withColumn(out, F.arrow_udf(run, SCANNED).asNondeterministic()("text"))


ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))]
    + [(c, pa.string()) for c in TOLD]
)

_made: list[tuple[tuple, Scanner]] = []


def _scanner(*tables: Mapping) -> Scanner:
    """The worker's automaton for these tables, built once."""
    for known, scanner in _made:
        if known == tables:
            return scanner
    _made.append((tables, Scanner(*tables)))
    return _made[-1][1]
