from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ordinals, packing, sampling
from gleaner.operators.compose import skip_if_exists
from gleaner.plans import sft_data
from gleaner.session import get_session, scratch_root
from gleaner.sources import readers, writers


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordinals_and_running_sums(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("n")).repartition(partitions)
    out = ordinals.with_ordinal(df, "k", running={"start": "n"}, partitions=5)
    assert out.filter((F.col("ordinal") != F.col("k")) | (F.col("start") != 2 * F.col("k"))).count() == 0
    assert out.count() == 1000


def test_ids(spark):
    out = ordinals.add_id(spark.range(3).withColumnRenamed("id", "k"), "k", "id", "FR_data", start_index=5)
    assert sorted(r.id for r in out.collect()) == [f"FR_data-000000000{i}" for i in (5, 6, 7)]
    big = spark.range(1).select(ordinals.id_of(F.lit(12345678901), "x")).first()[0]
    assert big == "x-12345678901"


def test_position_spans_files(spark, tmp_path):
    for part, low in (("a", 0), ("b", 10), ("c", 13)):
        spark.range(low, {"a": 10, "b": 13, "c": 20}[part]).coalesce(1).write.parquet(f"{tmp_path}/{part}")
    paths = [f"{tmp_path}/{p}" for p in "abc"]
    out = ordinals.read_with_position(spark, paths)
    assert out.filter("id <> ordinal").count() == 0
    assert ordinals.row_at(spark, paths, 12).first().id == 12
    with pytest.raises(IndexError):
        ordinals.row_at(spark, paths, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_contiguous_split(spark):
    out = ordinals.split_by_order(spark.range(1000), {"train": 0.995, "validation": 0.005, "test": 0.0}, "id")
    assert {(r.split, r["count"]) for r in out.groupBy("split").count().collect()} == {("train", 995), ("validation", 5)}
    with pytest.raises(ValueError):
        ordinals.split_by_order(spark.range(3), {"a": 0.5}, "id")


def test_split_ratio_guard_and_determinism(spark):
    df = spark.range(2000)
    for ratio in (0.0, 1.0):
        with pytest.raises(ValueError):
            sampling.split_train_validation(df, ratio, ["id"])
    picks = [
        {r.id for r in sampling.split_train_validation(df.repartition(n), 0.1, ["id"]).filter("split = 'validation'").collect()}
        for n in (1, 6)
    ]
    assert picks[0] == picks[1] and 140 < len(picks[0]) < 260


def test_samples(spark):
    df = spark.range(5000)
    assert sampling.sample_exactly(df, 123, "id").count() == 123
    assert 400 < sampling.sample_about(df, 500, "id").count() < 600
    assert sorted(r.id for r in sampling.first_n(df, 10, "id").collect()) == list(range(10))
    assert sampling.pick_among_first(df, 10, "id").first().id < 10
    assert sampling.sample_exactly(df, 9000, "id").count() == 5000
    order = [r.id for r in sampling.shuffle(df, "id").collect()]
    assert order == [r.id for r in sampling.shuffle(df.repartition(3), "id").collect()] and order != sorted(order)


def test_packing_rebuilds_the_token_stream(spark):
    docs = [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate([3, 0, 25, 1, 7, 40])]
    df = spark.createDataFrame(docs, "id long, tokens array<int>").withColumn("n_tokens", F.size("tokens")).repartition(3)
    stream = [t for _, tokens in docs for t in tokens]
    samples = packing.pack_samples(df, 8).orderBy("sample").collect()
    assert [t for s in samples for t in s.tokens] == stream
    assert {len(s.tokens) for s in samples[:-1]} == {8}
    assert packing.pack_samples(df, 8, drop_last=True).count() == len(stream) // 8
    budget = packing.token_budget(df, 2, 8, "floor").first()
    assert (budget.n_tokens, budget.steps_by_tokens, budget.steps_by_documents) == (76, 4, 3)


def test_reading_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, f"{tmp_path}/none/*.parquet")
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path), "json")
    spark.range(3).withColumn("prompt", F.lit("p")).write.parquet(f"{tmp_path}/good")
    spark.range(3).write.parquet(f"{tmp_path}/bad")
    readers.require_columns(spark, f"{tmp_path}/good", ["id", "prompt"])
    with pytest.raises(ValueError, match="prompt"):
        readers.require_columns(spark, f"{tmp_path}/*", ["prompt"])


def test_nulls_stay_in_json_and_folders_keep_the_column(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "fr"), ("b", "x", "es")], "text string, url string, lang string")
    counts = writers.separate_by_field(df, f"{tmp_path}/out", "lang", compact=True)
    assert {(r.lang, r.n_documents) for r in counts.collect()} == {("fr", 1), ("es", 1)}
    raw = [r.value for r in spark.read.text(f"{tmp_path}/out/by_lang=fr").collect()]
    assert raw == ['{"text":"a","url":null,"lang":"fr"}']


def test_non_ascii_is_written_as_is(spark, tmp_path):
    writers.write_documents(spark.createDataFrame([("नमस्ते é",)], "text string"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"text":"नमस्ते é"}']


def test_lines_refuse_line_breaks(spark, tmp_path):
    with pytest.raises(Exception, match="line break"):
        writers.write_lines(spark.createDataFrame([("a\nb",)], "text string"), f"{tmp_path}/out")


def test_finished_stage_is_not_run_again(spark, tmp_path):
    path = f"{tmp_path}/stage"
    assert skip_if_exists(path, lambda: spark.range(3), spark).count() == 3
    assert skip_if_exists(path, lambda: 1 / 0, spark).count() == 3


def test_rows_are_dealt_out_only_when_asked(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    plans = [
        readers.read_documents(spark, f"{tmp_path}/one", partitions=n)._jdf.queryExecution().executedPlan().toString() for n in (None, 6)
    ]
    assert ["Exchange" in p for p in plans] == [False, True]


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert get_session() is not None


def test_prompt_label_files_end_to_end(spark, tmp_path):
    rows = [(f" q{i} ", f"a{i}") for i in range(400)] + [(None, "a"), ("q", " ")]
    spark.createDataFrame(rows, "prompt string, label string").repartition(3).write.parquet(f"{tmp_path}/in")
    glob = f"{tmp_path}/in/*.parquet"
    counts = {r.split: r.n_rows for r in sft_data.prepare_jsonl(spark, glob, f"{tmp_path}/out", val_ratio=0.1).collect()}
    assert sum(counts.values()) == 400 and 15 < counts["validation"] < 75
    sft_data.combine_jsonl(spark, glob, f"{tmp_path}/combined")
    assert spark.read.json(f"{tmp_path}/combined").select("text").filter("text = ' q7 \\na7'").count() == 1
    report = sft_data.validate(spark, glob).first()
    assert (report.total_rows, report.checked_rows) == (402, 400)
    assert sft_data.sample_check(spark, glob).first().full_text.startswith("<start_of_turn>user\nq")
    assert sft_data.show_row(spark, glob, 5).first().ordinal == 5
    with pytest.raises(ValueError):
        sft_data.prepare_jsonl(spark, glob, f"{tmp_path}/out", val_ratio=1.0)
    with pytest.raises(ValueError, match="nothing"):
        sft_data.validate(spark, glob, prompt_col="nothing")


def test_pretraining_stage_is_reused(spark, tmp_path):
    from gleaner.plans.curation import curate_pretraining_corpus

    path = "/root/testdata/sf0.001/documents.parquet"
    first = curate_pretraining_corpus(spark, path, "HI", str(tmp_path)).count()
    assert readers.exists(spark, f"{tmp_path}/formatted/_SUCCESS")
    assert curate_pretraining_corpus(spark, path, "HI", str(tmp_path)).count() == first > 100


def test_row_wise_plan_runs_on_a_stream(spark, tmp_path):
    from gleaner.plans.curation import curate_web_corpus, heuristic_filter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    plan = heuristic_filter(curate_web_corpus(stream))
    run = plan.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    run.start(f"{tmp_path}/out").awaitTermination(120)
    want = {r.doc_id for r in heuristic_filter(curate_web_corpus(docs)).collect()}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and len(want) > 100


def test_row_at_reads_the_file_that_holds_the_row(spark, tmp_path):
    spark.range(1000).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/in")
    found = ordinals.row_at(spark, f"{tmp_path}/in", 700)
    assert found.first().id == 700 and len(found.inputFiles()) == 1
    for bad in (-1, 1000):
        with pytest.raises(IndexError):
            ordinals.row_at(spark, f"{tmp_path}/in", bad)


def test_places_need_no_exchange_of_the_rows(spark, tmp_path):
    spark.range(50).withColumn("text", F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/in")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        plan = ordinals.read_with_position(spark, f"{tmp_path}/in")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_document_of_a_million_tokens_is_packed(spark):
    df = spark.range(1).select(F.col("id"), F.sequence(F.lit(1), F.lit(1_000_000)).alias("tokens")).withColumn("n_tokens", F.size("tokens"))
    packed = packing.pack_samples(df, 512)
    assert packed.agg(F.count("*"), F.sum(F.size("tokens"))).first() == (1954, 1_000_000)
