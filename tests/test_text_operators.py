from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import modify, pii
from gleaner.functions.tokenize import encoder_tokens, hashed_tokens
from gleaner.operators import classify, decontaminate, sft
from gleaner.operators.compose import Modify, Sequential


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def column(df, name="text"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_quotes_tags_and_urls(spark):
    df = texts(
        spark,
        "Ryan went out to play ‘footbal’",
        "He is very  \t  happy.",
        "Visit <a href='www.example.com'>example.com</a> for more information or contact us at info@example.com",
        "“see” http://a.b/c?d=%20e f",
    )
    assert column(Modify(modify.unify_quotes_and_tags)(df)) == [
        "Ryan went out to play 'footbal'",
        "He is very     happy.",
        "Visit example.com for more information or contact us at info@example.com",
        '"see"  f',
    ]


@pytest.mark.parametrize(
    ("broken", "whole"),
    [
        ("schÃ¶n", "schön"),
        ("â€œquotedâ€\u009d and itâ€™s", "“quoted” and it’s"),
        ("café", "café"),
        ("ﬁne ﬂow", "fine flow"),
        ("ＡＢＣ", "ABC"),
        ("a &lt; b &amp; c", "a < b & c"),
        ("<b>a &amp; b</b>", "<b>a &amp; b</b>"),
        ("one\r\ntwo three\x00", "one\ntwo\nthree"),
        ("नमस्ते".encode().decode("latin-1").encode("latin-1").decode("windows-1252", "replace"), None),
        ("été à Ã", "été à Ã"),
        ("नमस्ते Straße", "नमस्ते Straße"),
    ],
)
def test_unicode_repair(broken, whole):
    if whole is not None:
        assert modify.reformat_text(broken) == whole
    once = modify.reformat_text(broken)
    assert modify.reformat_text(once) == once


def test_unicode_repair_on_spark(spark):
    assert column(Modify(modify.reformat_unicode)(texts(spark, "schÃ¶n", None, "ok"))) == ["schön", None, "ok"]


def test_chat_turns_and_label(spark):
    row = texts(spark, " p ").select(
        modify.chat_turns(F.col("text"), F.lit(" l ")).alias("chat"), modify.label_prefix("__label__hq")(F.lit("a\nb")).alias("line")
    ).first()
    assert row.chat == "<start_of_turn>user\np<end_of_turn>\n<start_of_turn>model\nl<end_of_turn>"
    assert row.line == "__label__hq a b"


def test_spans_of_the_toy_texts(spark):
    df = texts(spark, "My name is Dana and my number is 212-555-5555", "मेरा ईमेल suresh@example.com है", None)
    spans = column(df.withColumn("text", pii.analyze(F.col("text"))))
    assert [tuple(s) for s in spans[0]] == [("PERSON", 11, 15, 0.85), ("PHONE_NUMBER", 33, 45, 0.75)]
    hindi = "मेरा ईमेल suresh@example.com है"
    assert [hindi[s.start : s.end] for s in spans[1]] == ["suresh@example.com"] and spans[2] is None


def test_redaction_native_equals_spliced(spark):
    values = [
        "His email is ryan@example.com and phone is 212-555-5555",
        "Ryan went out to play football 😀 at 10.1.2.3",
        "call +1 (212) 555-1234 or 123-45-6789, see https://a.b/c?x=1 and www.c.d",
        "", None,
    ]
    kinds = [e for e in pii.ENTITIES if e != "CREDIT_CARD"]
    native = column(texts(spark, *values).withColumn("text", pii.redact(F.col("text"), kinds)))
    spliced = column(texts(spark, *values).withColumn("text", pii.redact(F.col("text"))))
    assert native == spliced
    assert native[0] == "His email is <EMAIL_ADDRESS> and phone is <PHONE_NUMBER>"
    assert native[1] == "<PERSON> went out to play football 😀 at <IP_ADDRESS>"
    assert native[2] == "call <PHONE_NUMBER> or <US_SSN>, see <URL> and <URL>"


def test_card_numbers_need_their_check_digit(spark):
    df = texts(spark, "4111 1111 1111 1111", "4111 1111 1111 1112")
    assert column(df.withColumn("text", pii.redact(F.col("text"), ["CREDIT_CARD"]))) == ["<CREDIT_CARD>", "4111 1111 1111 1112"]


def test_entity_subset_and_errors(spark):
    df = texts(spark, "Dana 212-555-5555")
    assert column(df.withColumn("text", pii.redact(F.col("text"), ["PERSON"]))) == ["<PERSON> 212-555-5555"]
    with pytest.raises(ValueError):
        pii.redact(F.col("text"), ["NO_SUCH"])
    lexicon = pii.Lexicon(given_names=("Zork",))
    assert column(texts(spark, "Zork Dana").withColumn("text", pii.redact(F.col("text"), ["PERSON"], lexicon=lexicon))) == ["<PERSON>"]


def test_clean_pairs_and_report(spark):
    rows = [(" p ", "l"), (None, "l"), ("p", None), (" ", ""), ("p", "word " * 50)]
    df = spark.createDataFrame(rows, "prompt string, label string")
    assert sft.clean_pairs(df).count() == 2
    report = sft.validation_report(df, seq_length=40).first()
    assert (report.total_rows, report.checked_rows, report.empty_prompts, report.empty_labels) == (5, 2, 2, 1)
    assert report.over_length == 1 and report.over_length_percent == 20.0
    assert sft.validation_report(df.limit(0)).first().over_length_percent is None


def test_loss_mask(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4, 5])], "u array<int>, f array<int>")
    assert df.select(sft.loss_mask(F.col("u"), F.col("f"))).first()[0] == [-100, -100, -100, 4, 5]
    with pytest.raises(Exception, match="mask length"):
        df.select(sft.loss_mask(F.col("f"), F.col("u"))).collect()


def test_tokens_masks_and_padding(spark):
    df = spark.createDataFrame([(i, "ask this", "word " * (i + 1)) for i in range(4)], "o long, prompt string, label string")
    rows = sft.tokenize_pairs(df).filter(sft.prompt_is_prefix())
    assert rows.count() == 4
    padded = sft.pad_batches(rows, "o", 2, pad_id=7).orderBy("o").collect()
    assert [r.batch for r in padded] == [0, 0, 1, 1]
    assert len(padded[0].input_ids) == len(padded[1].input_ids) and padded[0].input_ids[-1] == 7
    assert padded[0].labels[-1] == -100
    assert df.select(F.size(sft.truncate(hashed_tokens()(F.col("label")), 2))).first()[0] == 1


def test_any_encoder(spark):
    encode = encoder_tokens(lambda: lambda batch: [[ord(c) for c in t] for t in batch])
    assert column(texts(spark, "ab", None, "c").withColumn("text", encode(F.col("text")))) == [[97, 98], None, [99]]


def test_map_columns(spark):
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert sft.map_columns(df, {"question": "prompt", "answer": "label"}).columns == ["prompt", "label"]
    with pytest.raises(ValueError):
        sft.map_columns(df, {"nothing": "prompt"})


def brute_hits(text, bench, n):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = {tuple(words(b)[i : i + min(n, len(words(b)))]) for b in bench for i in range(max(1, len(words(b)) - n + 1)) if words(b)}
    w = words(text)
    return {(i, len(r)) for r in runs for i in range(len(w) - len(r) + 1) if tuple(w[i : i + len(r)]) == r}


@pytest.mark.parametrize("block_chars", [4_000_000, 12])
def test_contamination_equals_brute_force(spark, block_chars):
    bench = ["The quick brown fox jumps over it", "one two three", "short, item", None, "..."]
    docs = ["a b the QUICK brown; fox jumps over c", "one two, three four one two three", "nothing here", "two three", "", "a SHORT item!", "a_short_item", None]
    df = texts(spark, *docs)
    tasks = spark.createDataFrame([(b,) for b in bench], "text string")
    hits = decontaminate.contaminated_positions(df, tasks, 3, "id", block_chars=block_chars)
    got = {(r.id, r.pos, r.n_words) for r in hits.collect()}
    assert got == {(i, *h) for i, d in enumerate(docs) for h in brute_hits(d or "", [b for b in bench if b], 3)}
    kept = decontaminate.remove_contaminated_documents(df, tasks, 3, "id", block_chars=block_chars)
    assert {r.id for r in kept.collect()} == {2, 3, 4, 7}


def test_every_piece_of_a_cut_document_stays(spark):
    df = texts(spark, " ".join(f"part{i} x y z" for i in range(50)))
    tasks = spark.createDataFrame([("x y z",)], "text string")
    out = decontaminate.remove_contaminated_sections(df, tasks, 13, "id").orderBy("piece").collect()
    assert [r.text for r in out] == [f"part{i}" for i in range(50)]


@pytest.mark.parametrize(
    "text",
    ["http://a.b/" + "c" * 100_000, "x@" + "a." * 50_000 + "com", "<" + "b" * 100_000 + ">", "4" * 100_000, "x@" + "a" * 100_000 + ".com", "http://" + "%20" * 40_000, "1 " + "Aa " * 40_000],
)
def test_long_runs_do_not_overflow_the_stack(spark, tmp_path, text):
    texts(spark, text).write.parquet(f"{tmp_path}/t")  # stored, so that the engine's own code runs on it
    df = spark.read.parquet(f"{tmp_path}/t")
    kinds = [k for k in pii.ENTITIES if k != "CREDIT_CARD"]
    assert df.select(modify.unify_quotes_and_tags(F.col("text")), pii.redact(F.col("text"), kinds), pii.redact(F.col("text"))).count() == 1
    out = df.select(modify.unify_quotes_and_tags(F.col("text")).alias("a"), pii.redact(F.col("text"), kinds).alias("b")).first()
    assert out.a is not None and out.b is not None


def test_overlapping_spans_go_by_score_then_length(spark):
    df = texts(spark, "at 12 Ryan Street", "see www.x.org/1.2.3.4 now")
    spans = [[(s["type"], s["start"], s["end"]) for s in row] for row in column(df.withColumn("text", pii.analyze(F.col("text"))))]
    assert spans == [[("PERSON", 6, 17)], [("URL", 4, 21)]]


def test_many_spans_take_time_in_proportion():
    assert len(pii.find_spans("10.0.0.1 " * 50_000, pii._compile(["IP_ADDRESS"], pii.Lexicon()))) == 50_000


def test_contaminated_sections_are_cut_out(spark):
    df = texts(spark, "keep  this\nstart x y z and this end", "x y z", "untouched text")
    tasks = spark.createDataFrame([("X y z",)], "text string")
    out = decontaminate.remove_contaminated_sections(df, tasks, 3, "id", min_chars=5)
    got = sorted((r.id, r.piece, r.text) for r in out.collect())
    assert got == [(0, 0, "keep  this\nstart"), (0, 1, "and this end"), (2, 0, "untouched text")]
    assert decontaminate.remove_contaminated_sections(df, tasks, 3, "id", min_chars=1, max_pieces=1).filter("id = 0").count() == 0


def test_language_model_is_accurate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = classify.train_language_model(docs.filter("doc_id % 2 = 0"))
    scored = classify.identify_language(docs.filter("doc_id % 2 = 1"), model)
    right = scored.agg(F.avg((F.upper("lang") == classify.language_code()).cast("int"))).first()[0]
    assert right > 0.98
    assert classify.identify_language(docs, model, min_score=1.1).count() == 0


def test_domain_model_takes_known_domains_and_any_function(spark):
    rows = [("Health", "doctor medicine hospital"), ("Sports", "football match goal")] * 5
    df = spark.createDataFrame(rows, "domain string, text string")
    model = classify.train_domain_model(df)
    new = texts(spark, "the hospital doctor", "a football goal")
    assert column(classify.classify_domain(new, model), "domain_pred") == ["Health", "Sports"]
    assert column(classify.classify_domain(new, lambda d: d.withColumn("domain_pred", F.lit("News"))), "domain_pred") == ["News"] * 2
    with pytest.raises(Exception, match="unknown domain"):
        classify.train_domain_model(df.withColumn("domain", F.lit("Nonsense")))
    assert len(classify.DOMAINS) == 26


def test_quality_model_separates_its_labels(spark):
    good, bad = "a clear sentence about science", "buy cheap now click here"
    lines = spark.createDataFrame([(f"__label__hq {good}",), (f"__label__lq {bad}",)] * 10, "value string")
    model = classify.train_quality_model(classify.read_training_lines(lines), lr=0.5, epoch=20, buckets=1 << 10)
    scores = column(classify.score_quality(texts(spark, good, bad), model), "quality_score")
    assert scores[0] > 0.6 > 0.4 > scores[1]


def test_sequence_nests_and_takes_functions(spark):
    steps = Sequential([Sequential([Modify(F.upper)]), lambda d: d.filter("id = 1")])
    assert column(steps(texts(spark, "a", "b"))) == ["B"]
