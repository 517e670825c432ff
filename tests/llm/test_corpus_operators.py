from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import ALNUM_WORDS, SPACE_WORDS, base_quality, benchmark_hits, corpus, empty, frame, lower, near_components, repeated_lines, repeated_substrings, same
from pyspark.sql import functions as F

from gleaner.llm import bbit, bestfit, htmltext, license, linededup, quality, substring, textmodel, toxicity, words, wumanber

DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).persist()


@pytest.mark.parametrize("pattern,separators,fold", [(SPACE_WORDS, words.SPACE, words.SAME), (ALNUM_WORDS, words.NON_ALNUM, words.LOWER)])
def test_words_are_those_of_the_pattern(pattern, separators, fold):
    texts = [t or "" for _, t in DOCS] + ["\x1c x\x1d", "a b", "", "é", "  ", "A" * 3_000_000 + " b"]
    cut = words.cut_words(*words.texts_of(pa.array(texts)), separators, fold)
    got = [(int(t), bytes(cut.data[a:b])) for t, a, b in zip(cut.text, cut.starts, cut.ends)]
    source = [lower(t) if fold is words.LOWER else t for t in texts]
    assert got == [(i, w.encode()) for i, t in enumerate(source) for w in pattern.findall(t)]
    by_hash = {}
    for h, (_, w) in zip(cut.hashes.tolist(), got):
        assert by_hash.setdefault(h, w) == w
    assert len(set(by_hash.values())) == len(by_hash)


def test_windows_are_equal_where_their_words_are():
    texts = ["a b c d a b c d", "b c d a", "a"]
    cut = words.cut_words(*words.texts_of(pa.array(texts)), words.SPACE)
    at, hashes = words.windows(cut, 3)
    seqs = [" ".join(bytes(cut.data[cut.starts[i] : cut.ends[i]]).decode() for i in range(a, a + 3)) for a in at]
    assert seqs == ["a b c", "b c d", "c d a", "d a b", "a b c", "b c d", "b c d", "c d a"]
    assert len(set(hashes.tolist())) == 4 and len({(s, h) for s, h in zip(seqs, hashes.tolist())}) == 4


@pytest.mark.parametrize("size,cells", [(50, 1 << 28), (7, 1 << 28), (10, 1 << 16)])
def test_substrings(docs, size, cells):
    got = substring.remove_repeated_substrings(docs, size=size, max_cells=cells).drop("kept_text").collect()
    assert same(got, repeated_substrings(DOCS, size))


def test_substrings_settled_within_a_task_or_by_spark_alike(spark, docs):
    expected = repeated_substrings(DOCS, 20)
    for parts in (1, 40):
        assert same(substring.remove_repeated_substrings(docs.repartition(parts), size=20, keep_text=False).drop("kept_text").collect(), expected)


def test_sketch_never_counts_too_little():
    texts = pa.array([t for _, t in DOCS if t])
    cut = words.cut_words(*words.texts_of(texts), words.SPACE)
    at, hashes = substring.anchors(cut, 10)
    _, windows = words.windows(cut, 10)
    anchor_of = {}
    for w, a in zip(windows.tolist(), hashes.tolist()):
        assert anchor_of.setdefault(w, a) == a  # equal windows have equal anchors


def test_lines(docs):
    got = linededup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped").collect()
    expected = repeated_lines(DOCS)
    assert same(got, [r[:3] for r in expected])
    texts = linededup.drop_repeated_lines(docs)
    assert texts.columns == docs.columns
    plain = [(i, t if not n else kept) for (i, t), (_, _, n, kept) in zip(DOCS, expected)]
    assert same(texts.select("doc_id", "text").collect(), plain)


def test_lines_of_a_very_long_document(spark):
    shared = [f"this is the shared line number {i}" for i in range(3000)]
    rows = [(i, "\n".join(shared) + "\nown") for i in range(3)] + [(9, shared[0].upper() + "  ")]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), slices=2).select("doc_id", "n_lines", "n_dropped").collect()
    assert same(got, [(0, 3001, 3000), (1, 3001, 3000), (2, 3001, 1), (9, 1, 0)])


@pytest.mark.parametrize("size,block", [(4, 1 << 20), (5, 1 << 20), (4, 50)])
def test_near_duplicates(docs, size, block):
    got = bbit.near_duplicates(docs, size=size, block_shingles=block).collect()
    assert same(got, near_components(DOCS, size))


def test_near_duplicates_through_members_unlike_the_centre(spark):
    """Documents whose bucket's smallest member is unlike them are still linked with each other."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(40):  # variants of one text, from 3 to 9 words changed
        text = list(base)
        for at in rng.choice(100, 3 + i % 7, replace=False):
            text[at] = f"u{rng.integers(1000)}"
        rows.append((i, " ".join(text)))
    got = bbit.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2, block_shingles=700).collect()
    assert same(got, near_components(rows, 2))


def test_near_duplicates_keep_one_of_each(docs):
    kept = bbit.drop_near_duplicates(docs, size=4)
    assert kept.columns == docs.columns
    assert same(kept.select("doc_id", "text").collect(), [d for d, r in zip(DOCS, near_components(DOCS, 4)) if r[3]])


def test_agreement_is_counted_by_lane(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 64, (2, 200, 8), dtype=np.uint64)
    b[:, :5] ^= rng.integers(0, 4, (200, 5), dtype=np.uint64) << np.uint64(8)
    lanes = lambda x: (x[..., None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)
    want = (lanes(a) == lanes(b)).sum(axis=(1, 2)).tolist()
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").orderBy("i").select(bbit.agreeing_lanes("a", "b").alias("n"))
    assert [r["n"] for r in df.collect()] == want


ITEMS = [(1, DOCS[2][1][:200]), (2, "one two three"), (3, "single"), (4, None), (5, " ... "), (6, DOCS[2][1][:200]), (None, "w1 w2 w3 w4"), (7, "One, TWO; three! " + DOCS[9][1][50:200])]


@pytest.mark.parametrize("block_windows", [500_000, 20])
def test_benchmark_hits(spark, docs, block_windows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = F.col("hits")
    got = wumanber.benchmark_hits(docs, items, block_windows=block_windows, out="hits").select("doc_id", found["n_words"], found["n_hit"], found["items"])
    expected = benchmark_hits(DOCS, [("" if n is None else n, t) for n, t in ITEMS])
    assert same([(*r[:3], tuple(r[3])) for r in got.collect()], [(*r[:3], tuple(r[3])) for r in expected])
    kept = wumanber.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert same(kept.select("doc_id", "text").collect(), [d for d, r in zip(DOCS, expected) if not (r[2] and 20 * r[2] >= r[1])])


@pytest.mark.parametrize("length", [1, 2, 3, 13, 300])
def test_wu_manber_finds_what_a_plain_search_finds(length):
    rng = np.random.default_rng(length)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3, n)) for n in (0, 1, 5, 400, 3000)]
    cut = words.cut_words(*words.texts_of(pa.array(texts)), words.NON_ALNUM)
    item = " ".join(f"v{x}" for x in rng.integers(0, 3, 8))
    rows = [("a", item if length < 300 else " ".join(texts[4].split()[700:1000])), ("b", " ".join(texts[3].split()[100 : 100 + max(2, length)]))]
    for patterns in wumanber.build_patterns(rows, length):
        starts, numbers = patterns.search(cut, len(texts))
        got = {(int(s), int(k)) for s, k in zip(starts, numbers)}
        n = len(cut.hashes)
        want = {
            (s, k)
            for k, p in enumerate(patterns.hashes)
            for s in range(n - patterns.length + 1)
            if cut.text[s] == cut.text[s + patterns.length - 1] and (cut.hashes[s : s + patterns.length] == p).all()
        }
        assert got == want


def test_license_places(docs):
    extra = [(900, "Under the MIT license; under-the-mit-license. CC BY-NC! Apache License, Version 2.0"), (901, "under the mit licenses"), (902, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n// spdx-license-identifier : Foo")]
    rows = DOCS + extra
    got = {i: r for (i, _), r in zip(rows, [license.Scanner(license.BASE_PHRASES, license.NOTICE_PHRASES, license.IDENTIFIERS).scan((t or "").encode()) for _, t in rows]) if i is not None}
    assert got[900][:5] == (16, 4, 0, 11, "apache-2,cc-by-nc,mit")
    assert got[901][1:4] == (0, None, None)
    assert got[902][5:8] == ("bsd-3-clause,foo,gpl,mit", 1.0, ["(MIT OR GPL-2.0-only) AND BSD-3-Clause", "Foo"])
    out = license.scan_licenses(docs).select("doc_id", "license.n_words", "license.score", "found").collect()
    assert same([r[:2] for r in out], [(i, len(ALNUM_WORDS.findall(lower(t or "")))) for i, t in DOCS]) and {r["found"] for r in out} == {"f"}


@pytest.mark.parametrize(
    "text,postfix",
    [
        ("MIT or Apache-2.0 and ISC", "mit apache-2.0 isc and or"),
        ("(MIT or Apache-2.0) and ISC", "mit apache-2.0 or isc and"),
        ("GPL-2.0-only with Classpath-exception-2.0 or MIT", "gpl-2.0-only classpath-exception-2.0 with mit or"),
        ("MIT */", "mit"),
        ("MIT and", "mit"),
        ("((MIT)", None),
        ("or MIT", None),
        ("", None),
    ],
)
def test_shunting_yard(text, postfix):
    assert license.to_postfix(text) == (postfix.split() if postfix else None)


def test_evaluation():
    either, both = license.evaluate("MIT OR GPL-3.0-only"), license.evaluate("MIT AND GPL-3.0-only")
    assert either.permissive and not both.permissive and either.labels == both.labels == {"mit", "gpl"}
    assert license.evaluate("GPL-2.0-only WITH Classpath-exception-2.0").labels == {"gpl", "classpath-exception-2.0"}
    assert not license.evaluate("Foo").known and license.evaluate(")") is None


def test_html():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><a href=/a>A</a></nav><div class='side-bar sidebar'><p>links</p></div><article><header><h1>Head &amp; more</h1></header>"
        "<p><b>First <i>par</i>a\n graph<br>goes on<p>Second&nbsp;one &lt;ok&gt;</p><div class=ad>Buy</div><form><p>mail</p></form><!-- no --><ul><li>x<li>y</ul>"
        "<section id=comments><p>A reader says a lot of things here.</p></section>tail</article><footer>f</footer></body></html>"
    )
    assert htmltext.extract(page) == "Head & more\nFirst para graph goes on\nSecond one <ok>\nx\ny\ntail"
    plain = "<div><div id='menu'><a>a</a><a>b</a></div><div><h2>T</h2><p>" + "Long text of the page. " * 9 + "<p>Short.</div><div class='reader-comments'><p>" + "No. " * 99 + "</div></div>"
    assert htmltext.extract(plain) == "T\n" + ("Long text of the page. " * 9).strip() + "\nShort."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain", "plain"), ("<", "<"), ("<p", ""), ("<script>x", ""), ("<p>a<p>b", "a\nb"), ('<p title="a>b">c', "c"), ("<p title=it's>c", "c"), ("&amp;lt;", "&lt;")])
def test_html_odd_pages(page, text):
    assert htmltext.extract(page) == text


def test_html_takes_time_in_proportion():
    for page in ("<b>" * 50_000 + "x", "<div>x" * 30_000 + "</p></i>" * 30_000, '<a "' * 50_000, "<p>x" * 50_000, "<ul><li>" * 30_000, "<" * 100_000):
        htmltext.extract(page)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "kept"), (2, None, None, None)], "page_id long, url string, html string, text2 string")
    assert same(htmltext.extract_main_text(df).collect(), [(1, "u", "<p>a</p>", "kept", "a"), (2, None, None, None, "")])


def labelled(n=400):
    rng = np.random.default_rng(5)
    good, bad = [f"good{i}" for i in range(50)], ["vile", "nasty%%%", "awful$$"]
    texts, labels = [], []
    for i in range(n):
        ws = list(rng.choice(good, 40))
        y = i % 3 == 0
        if y:
            ws[:4] = list(rng.choice(bad, 4))
        texts.append((i, " ".join(ws)))
        labels.append((i, 0 if y else 1, int(y)))
    return texts, labels


def test_classifiers_on_texts_they_have_not_seen(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(texts + [(1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    seen = marks.filter(~F.col("doc_id").isin(*held))
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, seen)).collect()}
    assert len(scored) == 402 and all(0 <= r["score"] <= 1 for r in scored.values())
    assert all(scored[i]["predicted"] == t for i, _, t in labels if i in held)
    judged = {r["doc_id"]: r["verdict"] for r in quality.judge_quality(docs, quality.train_quality(docs, seen)).collect()}
    assert all(judged[i]["kept"] == bool(q) for i, q, _ in labels if i in held) and not judged[1000]["kept"]


def test_counterfactual_penalty_stills_identity_terms(spark):
    """In the labels a group is named mostly by toxic texts; with the penalty its mention moves the score less."""
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(600):
        y = int(i % 2 == 0)
        ws = list(rng.choice([f"n{k}" for k in range(60)], 20))
        if y:
            ws[0] = rng.choice(["vile", "nasty"])
        if rng.random() < (0.9 if y else 0.1):
            ws[1] = "muslims"
        if rng.random() < 0.2:
            ws[2] = "christians"
        rows.append((i, " ".join(ws)))
        marks.append((i, y))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    probe = pa.array(["n1 n2 n3 n4 muslims n5 n6 n7", "n1 n2 n3 n4 christians n5 n6 n7", "n1 n2 n3 n4 vile n5 n6 n7"])
    plain = toxicity.train_toxicity(docs, labels, penalty=0.0).score(probe)
    fair = toxicity.train_toxicity(docs, labels, penalty=10.0).score(probe)
    assert plain[0] - plain[1] > 0.2 and plain[0] > 2 * fair[0] and abs(fair[0] - fair[1]) < 0.1 and fair[0] < 0.3 < fair[2]


def test_swapped_terms():
    swap, leave = toxicity.twins({"g": ("women", "men")})
    assert swap("Women and men, womens") == "men and women, womens" and leave("a men b") == "a  b" and toxicity.twins({}) == ()


def test_scores_equal_the_sum_over_sparse_features():
    texts = [t or "" for _, t in DOCS]
    for features in (toxicity.FEATURES, quality.FEATURES):
        weights = np.random.default_rng(1).normal(size=1 << features.bits)
        direct = features.scores(pa.array(texts, pa.large_string()), weights)
        rows = textmodel.sparse_rows(texts, features)
        assert np.allclose(direct, rows.times(weights), atol=1e-6)


def test_quality_counts(docs):
    model = textmodel.Model(quality.FEATURES, np.zeros((1 << quality.FEATURES.bits) + 1, np.float32), 1.0, 3.0)
    got = quality.judge_quality(docs, model).select("doc_id", *(f"verdict.{c}" for c in (*quality.COUNTS, "base_failed", "kept"))).collect()
    assert same(got, [(i, *(b := base_quality(t)), not b[-1]) for i, t in DOCS])
    assert quality.keep_good(docs, model).columns == docs.columns


def test_training_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()} == {0}


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    for capacity, lengths in ((10, [1, 9, 5, 5, 5, 3, 3, 3, 1]), (64, rng.integers(1, 65, 3000).tolist()), (4096, rng.integers(1, 400, 5000).tolist()), (4, [4] * 7 + [1]), (5, [])):
        counts = dict(zip(*np.unique(lengths, return_counts=True))) if lengths else {}
        plan, n = bestfit.plan_best_fit({int(k): int(v) for k, v in counts.items()}, capacity)
        used, ranks = {}, {}
        for length, lo, hi, first, offset in plan:
            assert ranks.setdefault(length, 0) == lo
            ranks[length] = hi
            for s in range(first, first + hi - lo):
                assert used.get(s, 0) == offset
                used[s] = offset + length
        assert ranks == counts and all(u <= capacity for u in used.values()) and len(used) == n
        assert n <= -(-sum(lengths) // capacity) * 1.02 + 1


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_words_give_the_ids_of_whole_texts():
    path, whole = tokenizer()
    texts = [t or "" for _, t in DOCS] + ["it's Don't!!", "<|endoftext|>x. <|EndOfText|>", "ΑΣ İi é ﬁ a b x1y22 ...'s 日本語。 Ⅷ ª ß! ́abc", "a\x1cb \x85 c"]
    encoder = bestfit.WordEncoder(path)
    assert encoder.direct
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_packing(docs, capacity):
    path, whole = tokenizer()
    pieces = bestfit.token_pieces(docs, path, capacity)
    expected = []
    for i, t in DOCS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    rows = bestfit.pack_best_fit(pieces, capacity, ["doc_id", "piece"]).collect()
    assert same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows], expected)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= capacity and len(ends) <= -(-sum(r[3] for r in expected) // capacity) * 1.05 + 1


def test_lengths_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, 5, 7), (2, None, 7), (3, 0, 7), (4, 11, 7)], "id long, length int, rank int")
    got = bestfit.pack_best_fit(df, 10, ["id"]).select("id", "rank", "sequence_id", "offset").collect()
    assert same(got, [(1, 7, 0, 0), (2, 7, None, None), (3, 7, None, None), (4, 7, None, None)])


def test_empty_tables(spark):
    none = empty(spark)
    path, _ = tokenizer()
    model = textmodel.Model(quality.FEATURES, np.zeros((1 << quality.FEATURES.bits) + 1, np.float32), 1.0, 0.0)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        substring.remove_repeated_substrings(none),
        linededup.line_dedup(none),
        linededup.drop_repeated_lines(none),
        bbit.near_duplicates(none),
        wumanber.benchmark_hits(none, items),
        license.scan_licenses(none),
        quality.judge_quality(none, model),
        toxicity.score_toxicity(none, model),
        bestfit.pack_best_fit(bestfit.token_pieces(none, path, 64), 64, ["doc_id"]),
        htmltext.extract_main_text(none.withColumn("html", F.col("text"))),
    ):
        assert out.count() == 0
    assert wumanber.drop_contaminated(frame(spark, DOCS), items).count() == len(DOCS)
