"""Small corpora with planted cases, and plain versions of the operators to hold results against."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, gone string, place int"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages and lines, chains of near copies, blank and long texts, nulls, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ñu", "The", "the", "a.b", "c,"]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = prose(70), "A line that is SHARED by many documents."
    docs: list[tuple[int | None, str | None]] = []
    for i in range(n):
        text = prose(rng.randint(20, 160))
        if i % 5 == 0:
            text = prose(10) + " " + passage + " " + prose(10)
        if i % 4 == 0:
            text += f"\n  {line if i % 8 else lower(line)}\t\n" + prose(5)
        docs.append((i, text))
    base = prose(120).split()
    for i in range(12):  # a chain: neighbours are alike, the ends are not
        words = list(base)
        for j in range(i * 4):
            words[j] = f"x{j}"
        docs.append((n + i, " ".join(words)))
    docs += [(n + 20, docs[7][1]), (n + 21, docs[7][1]), (n + 22, docs[3][1].replace(" ", "\t"))]
    docs += [(n + 30, ""), (n + 31, None), (n + 32, " \n\t "), (n + 33, "one"), (n + 34, "one two three"), (n + 35, "ONE two three")]
    docs += [(n + 40, "z" * 100_000), (n + 41, prose(6000)), (n + 42, passage + "\n" + passage)]
    docs += [(None, docs[0][1]), (None, None), (5, docs[5][1]), (5, docs[5][1]), (n + 43, "\x0b\x0c\r" + line + "\r\nx\n" + line)]
    return docs


def frame(spark, docs):
    """The rows with extra columns, some named like columns that operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "f", "g", 1) for i, t in docs], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated_substrings(docs, size=50):
    first: dict[tuple, int] = {}
    words = [(i, SPACE_WORDS.findall(t or "")) for i, t in docs]
    for i, ws in words:
        if i is not None:
            for p in range(len(ws) - size + 1):
                key = tuple(ws[p : p + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        if i is not None:
            for p in range(len(ws) - size + 1):
                if first[tuple(ws[p : p + size])] < i:
                    gone.update(range(p, p + size))
        text = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return out


def repeated_lines(docs, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, kept text) in the order of ``docs``."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, size):
    ws = SPACE_WORDS.findall(lower(text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)])


def near_components(docs, size, per_cent=80):
    """(doc_id, n_shingles, component, kept), all pairs compared."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            both = len(s & t)
            if 100 * both >= per_cent * (len(s) + len(t) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]


def benchmark_hits(docs, items, size=13):
    """(doc_id, n_words, n_hit, item names) for every document."""
    patterns = defaultdict(set)
    for name, text in items:
        ws = ALNUM_WORDS.findall(lower(text or ""))
        m = min(size, len(ws))
        for p in range(len(ws) - m + 1 if m else 0):
            patterns[tuple(ws[p : p + m])].add(str(name))
    lengths = {len(p) for p in patterns}
    out = []
    for i, t in docs:
        ws = ALNUM_WORDS.findall(lower(t or ""))
        hit, names = set(), set()
        for m in lengths:
            for p in range(len(ws) - m + 1):
                found = patterns.get(tuple(ws[p : p + m]))
                if found:
                    hit.update(range(p, p + m))
                    names |= found
        out.append((i, len(ws), len(hit), sorted(names)))
    return out


def base_quality(text):
    text = text or ""
    ws = SPACE_WORDS.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    windows = Counter(tuple(ws[p : p + 5]) for p in range(len(ws) - 4))
    again = {q for p in range(len(ws) - 4) if windows[tuple(ws[p : p + 5])] > 1 for q in range(p, p + 5)}
    failed = len(ws) < 10 or 100 * len(again) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def same(rows, expected):
    """Whether two lists hold the same rows, as often."""
    return Counter(map(tuple, rows)) == Counter(map(tuple, expected))
