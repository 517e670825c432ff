"""Word lists of any length, and one rule for overlapping spans."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import pii
from gleaner.functions.gazetteer import TOKEN, Gazetteer


def plain(text, phrases):
    """Longest phrase of each kind at every token, by comparing slices."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    out = []
    for i, (begin, _) in enumerate(spans):
        for kind, listed in phrases.items():
            ends = [spans[j][1] for j in range(i, len(spans)) if text[begin : spans[j][1]] in listed]
            if ends:
                out.append((kind, begin, max(ends)))
    return out


def test_longest_match_equals_comparing_slices():
    rng = random.Random(5)
    words = ["New", "York", "San", "José", "राम", "दिल्ली", "a", "St", "O", "Neil", "x1"]
    make = lambda n, gap: "".join(rng.choice(words) + rng.choice(gap) for _ in range(n)).strip()
    phrases = {k: {make(rng.randint(1, 3), [" ", " ", ". ", "'"]).strip(". '") for _ in range(25)} for k in ("PERSON", "LOCATION")}
    found = Gazetteer.of({k: sorted(v) for k, v in phrases.items()})
    texts = [make(rng.randint(0, 60), [" ", " ", "  ", ". ", "'", "\n"]) for _ in range(200)] + ["", "New", "..."]
    for text, spans in zip(texts, found.find(texts)):
        assert sorted(s[:3] for s in spans) == sorted(plain(text, phrases))


def test_a_list_from_a_table(spark):
    n = 120_000
    listed = spark.range(n).select(F.concat(F.lit("Name"), "id", F.lit(" of Place"), F.col("id") % 7).alias("phrase"), F.when(F.col("id") % 2 == 0, "PERSON").otherwise("LOCATION").alias("kind"))
    extra = spark.createDataFrame([("Name5", "LOCATION"), (None, "PERSON"), ("Zork", "OTHER"), ("दिल्ली", "LOCATION"), ("Name5", "LOCATION")], "phrase string, kind string")
    lexicon = pii.Lexicon.from_table(listed.unionByName(extra))
    texts = ["see Name4 of Place4 now", "Name5 of Place5, Name5 of Place6", "Zork in दिल्ली", "Name4  of Place4", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [r[0] for r in df.select(pii.redact(F.col("text"), ["PERSON", "LOCATION"], lexicon=lexicon)).collect()]
    assert out == ["see <PERSON> now", "<LOCATION>, <LOCATION> of Place6", "Zork in <LOCATION>", "Name4  of Place4", None]
    with pytest.raises(ValueError):
        pii.Lexicon.from_table(listed, max_names=1000)


def test_time_goes_with_the_text():
    gazetteer = pii.Lexicon().gazetteer()
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        gazetteer.find(["New York Maria word " * n])
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 0.5


@pytest.mark.parametrize("text", ["a." * 100_000, "%20" * 70_000, "a@" * 60_000, "x@" + "a." * 100_000, "@" * 100_000, "a.b@c." * 20_000])
def test_addresses_take_time_in_proportion(text):
    start = time.perf_counter()
    list(pii.emails(text))
    assert time.perf_counter() - start < 1


def test_addresses_are_those_of_the_pattern():
    rng = random.Random(3)
    pattern = re.compile(pii.PATTERNS["EMAIL_ADDRESS"][0])
    for _ in range(30_000):
        text = "".join(rng.choice(["a", "b1", ".", "..", "@", "@x.org", "com", "-", "%", "é", " ", "_", "x@y.co", "É."]) for _ in range(rng.randint(1, 12)))
        assert list(pii.emails(text)) == [m.span() for m in pattern.finditer(text)], text


def test_types_together_follow_one_rule(spark):
    """Whatever else is asked for: a span goes only where a better one overlaps it."""
    rng = random.Random(9)
    pieces = ["www.a.com/", "j.doe@x.org", " ", "4111 1111 1111 1111", "Dana", "Dana Smith ", "12 Ryan Street", "10.0.0.1", "2020-01-02", "212-555-5555", "Paris", "A12345678", "https://b.c/"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["see www.a.com/j.doe@x.org now"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for kinds in (pii.ENTITIES, [k for k in pii.ENTITIES if k != "CREDIT_CARD"], ["URL", "EMAIL_ADDRESS"]):
        rows = df.select("id", pii.analyze(F.col("text"), kinds).alias("spans"), pii.redact(F.col("text"), kinds).alias("text")).collect()
        for row in rows:
            text, at, parts = texts[row["id"]], 0, []
            for s in row["spans"]:
                assert s["start"] >= at
                parts += [text[at : s["start"]], f"<{s['type']}>"]
                at = s["end"]
            assert row["text"] == "".join(parts) + text[at:]
    assert rows[-1]["text"] == "see www.a.com/<EMAIL_ADDRESS> now"
