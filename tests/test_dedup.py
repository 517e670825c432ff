from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.minhash import orderings, shingle_values, signature
from gleaner.operators import dedup, fuzzy
from gleaner.operators.components import connected_components
from gleaner.operators.sampling import duplicate_samples
from gleaner.operators.skew import join_by_heavy_key


def corpus(spark, rows, partitions=4):
    return spark.createDataFrame(rows, "id long, text string").repartition(partitions)


def test_every_sample_twice_loses_exactly_half(spark):
    base = spark.createDataFrame([(f"text {i}",) for i in range(100)], "text string")
    twice = duplicate_samples(base).withColumn("id", F.monotonically_increasing_id())
    assert dedup.exact_duplicates(twice).count() == 200
    assert dedup.remove_exact_duplicates(twice).count() == 100


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("per_salt", [None, 3])
def test_one_text_holding_a_third_of_all_rows(spark, partitions, per_salt):
    rows = [(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(300)]
    df = corpus(spark, rows, partitions)
    seen, expected = set(), set()
    for i, t in rows:
        if t in seen:
            expected.add(i)
        seen.add(t)
    got = dedup.exact_duplicates_to_remove(df, rows_per_salt=per_salt)
    assert {r.id for r in got.collect()} == expected
    counts = {}
    for _, t in rows:
        counts[t] = counts.get(t, 0) + 1
    got = dedup.exact_duplicates(df, rows_per_salt=per_salt)
    assert {r.id for r in got.collect()} == {i for i, t in rows if counts[t] > 1}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_key_join_equals_plain_join(spark, how):
    rnd = random.Random(3)
    rows = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 3, 4, 99]), i) for i in range(200)], "k int, v int")
    table = spark.createDataFrame([(k, f"x{k}") for k in (1, 2, 3, 5)], "k int, x string")
    weights = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_by_heavy_key(rows, table, "k", weights, how, rows_per_salt=5)
    want = rows.join(table, "k", how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_heavy_rows_reach_many_tasks(spark):
    rows = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    table = spark.createDataFrame([(1, "x")], "k int, x string")
    weights = rows.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = join_by_heavy_key(rows, table, "k", weights, rows_per_salt=100)
        tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2500


def test_table_on_disk_is_read_again(spark, tmp_path):
    df = corpus(spark, [(0, "a"), (1, "a"), (2, "b")])
    dedup.exact_duplicates(df, cache_dir=str(tmp_path))
    saved = spark.read.parquet(f"{tmp_path}/_exact_duplicates.parquet")
    assert {r.id for r in saved.collect()} == {0, 1} and saved.columns == ["id", "_hashes"]


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 60)] + [(100 + i, i) for i in range(5)],
        [(random.Random(i).randrange(80), random.Random(i + 999).randrange(80)) for i in range(60)],
    ],
    ids=["chain", "star", "random"],
)
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.group for r in connected_components(df, rows_per_salt=4).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_text_ids_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {(r.id, r.group) for r in connected_components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=80), st.text(max_size=20))
def test_shingle_values_depend_on_the_shingle_alone(text, before):
    values = shingle_values(text, 5)
    assert len(values) == max(len(text) - 4, 1)
    if len(text) >= 5:
        assert set(values.tolist()) <= set(shingle_values(before + text, 5).tolist())


def test_signature_estimates_jaccard():
    factor, offset = orderings(2600, 42)
    rnd = random.Random(5)
    import numpy as np

    common, a, b = ([rnd.getrandbits(32) for _ in range(n)] for n in (600, 200, 200))
    same = signature(np.array(common + a, np.uint32), factor, offset) == signature(np.array(common + b, np.uint32), factor, offset)
    assert same.mean() == pytest.approx(0.6, abs=0.04)


def near_copies(n=30, size=400):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        text = "".join(rnd.choice("abcdefghij ") for _ in range(size))
        rows += [(2 * i, text), (2 * i + 1, text[:-4] + "####")]  # similarity about 0.98
    return rows


@pytest.mark.parametrize("options", [{}, {"bands_per_pass": 7}, {"false_positive_check": True}, {"rows_per_salt": 2}])
def test_planted_near_copies_are_found(spark, options):
    df = corpus(spark, near_copies())
    config = fuzzy.FuzzyConfig(**options)
    removed = {r.id for r in fuzzy.fuzzy_duplicates_to_remove(df, config).collect()}
    assert removed == {2 * i + 1 for i in range(30)}


def test_hot_group_of_exact_copies(spark):
    rows = [(i, "the very same text that a third of all documents share") for i in range(50)]
    rows += [(100 + i, f"text number {i} " + str(random.Random(i).random()) * 3) for i in range(100)]
    groups = fuzzy.fuzzy_duplicates(corpus(spark, rows), fuzzy.FuzzyConfig(rows_per_salt=5))
    assert {(r.id, r.group) for r in groups.collect()} == {(i, 0) for i in range(50)}


def test_no_near_copies_adds_nothing_and_short_texts_are_safe(spark):
    rows = [(i, str(random.Random(i).random()) * 5) for i in range(20)] + [(50, "ab"), (51, "ab"), (52, ""), (53, None)]
    groups = fuzzy.fuzzy_duplicates(corpus(spark, rows))
    assert {(r.id, r.group) for r in groups.collect()} == {(50, 50), (51, 50)}


def test_signatures_do_not_depend_on_partitions(spark):
    rows = near_copies(5)
    a, b = (fuzzy.signatures(corpus(spark, rows, n), fuzzy.FuzzyConfig()) for n in (1, 7))
    assert {r.id: tuple(r.signature) for r in a.collect()} == {r.id: tuple(r.signature) for r in b.collect()}


def test_check_drops_a_weak_edge_but_keeps_the_rest_of_the_bucket(spark):
    texts = ["a" * 10 + str(i) for i in range(3)]
    near = "x" * 10 + "".join(random.Random(1).choice("abc") for _ in range(300))
    df = spark.createDataFrame([(0, "q" * 100), (1, near), (2, near + "z"), (3, texts[0])], "id long, text string")
    buckets = spark.createDataFrame([(i, 0, 7, 7) for i in range(4)], "id long, band int, h1 long, h2 long")
    edges = fuzzy._confirmed_edges(buckets, df, fuzzy.FuzzyConfig())
    assert {(r.src, r.dst) for r in edges.collect()} == {(2, 1)}


def test_similarity_join_equals_all_pairs(spark):
    """Components of all pairs of a bucket that reach the similarity, in buckets of copies, near copies, chains and unlike members."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared = word(120)
    rows = [(i, shared + word(160)) for i in range(150)]  # unlike, with much in common
    base = word(300)
    rows += [(200 + i, base[: 300 - 8 * i] + word(8 * i)) for i in range(20)]  # a chain: neighbours are alike
    rows += [(300 + i, rows[5 + i % 3][1]) for i in range(30)] + [(400 + i, rows[7][1][:-3] + word(3)) for i in range(10)] + [(500, "short"), (501, "short")]
    df = spark.createDataFrame(rows, "id long, text string")
    named = [(i, 0, i % 2, 7) for i, _ in rows] + [(i, 1, 0, i % 3) for i, _ in rows if i >= 150]
    buckets = spark.createDataFrame(named, "id long, band int, h1 long, h2 long")
    got = fuzzy.connected_components(fuzzy._confirmed_edges(buckets, df, fuzzy.FuzzyConfig(char_ngrams=9, rows_per_salt=20)))

    sets = {i: fuzzy._shingles(t, 9) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_bucket = {}
    for i, *bucket in named:
        by_bucket.setdefault(tuple(bucket), []).append(i)
    for members in by_bucket.values():
        for x in members:
            for y in members:
                if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8:
                    a, b = root(x), root(y)
                    parent[max(a, b)] = min(a, b)
    groups = {i: root(i) for i in sets}
    shared_ids = {i for i in groups if list(groups.values()).count(groups[i]) > 1}
    assert {(r.id, r.group) for r in got.collect()} == {(i, groups[i]) for i in shared_ids}


def test_a_bucket_of_many_unlike_members(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared = word(300)
    rows = [(i, shared + word(200)) for i in range(2000)] + [(3000, None)]
    rows[-1] = (3000, rows[1234][1][:-2] + "zz")
    df = spark.createDataFrame(rows, "id long, text string")
    buckets = df.select("id", F.lit(0).alias("band"), F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"))
    edges = fuzzy._confirmed_edges(buckets, df, fuzzy.FuzzyConfig())
    assert {(r.src, r.dst) for r in edges.collect()} == {(3000, 1234)}


def test_null_texts_are_no_copies(spark):
    df = corpus(spark, [(1, None), (2, None), (3, "a"), (4, "a"), (5, "")])
    assert {r.id for r in dedup.remove_exact_duplicates(df).collect()} == {1, 2, 3, 5}


def test_equally_heavy_keys_lose_no_row(spark, monkeypatch):
    """As many heavy keys of one weight as the limit splits among: all or none of them are spread, alike on both sides."""
    from gleaner.operators import skew

    monkeypatch.setattr(skew, "PARTS", 3)
    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(40)], "k long, i long").repartition(6)
    table = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string")
    weights = rows.groupBy("k").agg(F.count("*").alias("n"))
    for per_salt in (1, 39, 40):
        out = join_by_heavy_key(rows, table, "k", weights, rows_per_salt=per_salt)
        assert out.count() == out.distinct().count() == 200
