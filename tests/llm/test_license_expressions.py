"""License expressions against all ways to choose, and hits in proportion."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.llm import license

NAMES = {"MIT": ("mit", True), "ISC": ("isc", True), "GPL-2.0-only": ("gpl", False), "MPL-2.0": ("mpl", False), "Foo": ("foo", None), "Bar.1": ("bar.1", None)}


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(list(NAMES))
    return (rng.choice(["OR", "AND"]), tree(rng, depth - 1), tree(rng, depth - 1))


def written(node, rng, above=0):
    if isinstance(node, str):
        return node + (" WITH Classpath-exception-2.0" if rng.random() < 0.1 else "")
    binding = 1 if node[0] == "OR" else 2
    text = f"{written(node[1], rng, binding)} {node[0] if rng.random() < 0.8 else node[0].lower()} {written(node[2], rng, binding)}"
    return f"({text})" if binding < above or rng.random() < 0.2 else text


def ways(node):
    """All sets of names that satisfy the expression."""
    if isinstance(node, str):
        return {frozenset([node])}
    left, right = ways(node[1]), ways(node[2])
    return left | right if node[0] == "OR" else {a | b for a in left for b in right}


def test_expressions_equal_all_ways_to_choose():
    rng = random.Random(7)
    for _ in range(3000):
        node = tree(rng, 4)
        text = written(node, rng)
        every = ways(node)
        label = lambda names: {NAMES[n][0] for n in names}
        value = license.evaluate(text)
        permissive = [w for w in every if all(NAMES[n][1] for n in w)]
        known = [w for w in every if all(NAMES[n][1] is not None for n in w)]
        assert value.obligations == frozenset.intersection(*map(frozenset, map(label, every))), text
        assert value.choice | value.obligations == set().union(*map(label, every))
        assert value.verdict == ("permissive" if permissive else "restricted" if known else "unknown")
        assert value.chosen in [frozenset(label(w)) for w in permissive or known or every]
        assert value.exceptions == ({"classpath-exception-2.0"} if "WITH" in text else set())


@pytest.mark.parametrize(
    "text,label,verdict",
    [
        ("GPL-2.0+", "gpl", "restricted"), ("GPL-2.0", "gpl", "restricted"), ("lgpl-2.1-or-later", "lgpl", "restricted"), ("Apache-2.0+", "apache-2", "permissive"),
        ("CC-BY-NC-SA-3.0", "cc-by-nc-sa", "restricted"), ("CC-BY-2.5", "cc-by", "permissive"), ("0BSD", "0bsd", "permissive"), ("BSL-1.0", "bsl", "permissive"),
        ("Nope-1.0+", "nope-1.0+", "unknown"), ("BSD-4-Clause", "bsd-4-clause", "permissive"), ("EPL-2.0.", "epl", "restricted"),
    ],
)
def test_names(text, label, verdict):
    value = license.evaluate(text)
    assert (value.labels, value.verdict) == ({label}, verdict)


def test_the_expression_decides_the_row(spark):
    texts = ["MIT OR GPL-2.0-only", "MIT AND GPL-2.0-only", "GPL-2.0-only WITH Classpath-exception-2.0", "Foo", "MIT\n// SPDX-License-Identifier: GPL-3.0+"]
    df = spark.createDataFrame([(i, f"x // SPDX-License-Identifier: {t}\n", "mine") for i, t in enumerate(texts)] + [(9, "no tag", "mine")], "doc_id int, text string, license string")
    rows = {r["doc_id"]: r for r in license.scan_licenses(df, out="found").select("doc_id", "license", "found.*").collect()}
    told = {i: tuple(rows[i][c] for c in ("verdict", "obligations", "choice", "chosen", "exceptions", "labels", "score")) for i in rows}
    assert told == {
        0: ("permissive", "", "gpl,mit", "mit", "", "gpl,mit", 1.0),
        1: ("restricted", "gpl,mit", "", "gpl,mit", "", "gpl,mit", 0.95),
        2: ("restricted", "gpl", "", "gpl", "classpath-exception-2.0", "classpath-exception-2.0,gpl", 0.95),
        3: ("unknown", "foo", "", "foo", "", "foo", 0.6),
        4: ("restricted", "gpl,mit", "", "gpl,mit", "", "gpl,mit", 1.0),
        9: (None, None, None, None, None, "", 0.0),
    }
    assert {r["license"] for r in rows.values()} == {"mine"}
    replaced = license.scan_licenses(df)
    assert replaced.columns == df.columns and replaced.filter(F.col("license.n_words") > 0).count() == 6


def test_many_hits_take_time_in_proportion():
    scanner = license.Scanner(license.BASE_PHRASES, license.NOTICE_PHRASES, license.IDENTIFIERS)
    text = b"under the MIT license " * 32_000
    start = time.perf_counter()
    found = scanner.scan(text)
    assert time.perf_counter() - start < 0.5
    assert found[:4] == (128_000, 32_000, 0, 127_996)
    start = time.perf_counter()
    assert license.evaluate("(" * 20_000 + "MIT" + ") OR ISC" * 20_000).verdict == "permissive"
    assert time.perf_counter() - start < 1
