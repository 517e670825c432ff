"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bbit import near_duplicates
from gleaner.llm.bestfit import pack_best_fit, token_pieces
from gleaner.llm.bitslices import whiten
from gleaner.llm.chatlog import conversation_digests, format_conversations, log_of_conversations
from gleaner.llm.hilbert import hilbert_shards
from gleaner.llm.htmltext import extract_main_text
from gleaner.llm.license import TOLD, scan_licenses
from gleaner.llm.linededup import apply_bitmap, drop_bitmaps, lines_of, with_row_key
from gleaner.llm.quality import COUNTS, judge_quality, train_quality
from gleaner.llm.substring import remove_repeated_substrings
from gleaner.llm.subvectors import cluster_vectors
from gleaner.llm.toxicity import score_toxicity, train_toxicity
from gleaner.llm.wumanber import benchmark_hits, is_contaminated
from gleaner.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_substrings(table(spark, sf_dir, "documents"), size=50, keep_text=False).drop("kept_text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train_toxicity(docs, labels.filter(~held_out))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *TOLD)
    return scanned.select("doc_id", *(F.col("license")[c].alias(c) for c in columns))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_row_key(table(spark, sf_dir, "documents"))
    bitmaps = drop_bitmaps(keyed, min_chars=20, min_docs=3)
    text = F.coalesce("text", F.lit(""))
    return keyed.join(bitmaps, ["doc_id", "row_key"], "left").select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(apply_bitmap(text, F.col("words")), 256).alias("kept_sha256"),
    )


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"),
        "lang",
        "source",
    )
    sharded = hilbert_shards(narrow, ["size"], ["lang", "source"], shards=40, tie=["text_key", "doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=4096, keep_ids=False).drop("ids")
    return pack_best_fit(pieces, capacity=4096, order=["doc_id", "piece"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    verdict = F.col("verdict")
    return judge_quality(docs, model).select("doc_id", *(verdict[c].alias(c) for c in (*COUNTS, "base_failed", "quality", "kept")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    return benchmark_hits(docs, table(spark, sf_dir, "benchmark"), size=13).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, similarity=0.8)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3).described()
    totals = (F.col(c).cast("long").alias(c) for c in ("cluster_inertia", "inertia"))
    return found.select("vec_id", "cluster", "distance", *totals, "centroid_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(table(spark, sf_dir, "embeddings"), components=4, dims=64, scale=256)
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    parts = format_conversations(log_of_conversations(conversations), message=("turn", "message", "copy"))
    return conversation_digests(parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_chat_formatting": op13_chat_formatting,
}
