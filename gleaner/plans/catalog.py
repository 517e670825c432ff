"""The registered queries: every operator over the given tables.  ``oracle.py`` holds the SQL of the same names."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import modify, pii
from gleaner.functions.charmodel import CharacterModel
from gleaner.functions.text import hash_unit, lines, sentences
from gleaner.functions.tokenize import hashed_tokens
from gleaner.operators import classify, compose, decontaminate, dedup, filters, fuzzy, ordinals, packing, sampling, sft
from gleaner.operators.components import connected_components
from gleaner.plans import curation, sft_data
from gleaner.plans.settings import BLOCK_TAG, DOMAIN_OF_LANGUAGE, MIN_LANGUAGE_SCORE, THREE_SCRIPTS
from gleaner.session import materialize, scratch_path, ship_package
from gleaner.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_NS, DUP_NS = (2, 3, 4), (5, 6, 7, 8, 9, 10)
SEED, VAL_RATIO, SEQ_LENGTH = 42, 0.02, 512
PII_TYPES = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS", "US_SSN", "PHONE_NUMBER"]


def register(name: str, fn: Query) -> None:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[name] = run


def query(fn: Query) -> Query:
    register(fn.__name__, fn)
    return fn


def input_partitions(spark: SparkSession) -> int | None:
    """A number of partitions that the session asks for, for small tables of a single row group; unset, the scan decides."""
    asked = spark.conf.get("spark.gleaner.inputPartitions", None)
    return int(asked) if asked else None


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return readers.read_documents(spark, f"{sf_dir}/{table}.parquet", columns=columns or None, partitions=input_partitions(spark))


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.pairs_from_turns(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def ids_as_text(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


# --- sources -------------------------------------------------------------------------------------------------


@query
def read_parquet_with_file_name(spark, sf_dir):
    return readers.read_documents(
        spark, f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"], add_filename=True
    )


@query
def read_json_with_file_name(spark, sf_dir):
    path = scratch_path(spark, "json")
    writers.write_documents(docs(spark, sf_dir, "doc_id", "text", "lang"), path)
    read = readers.read_documents(spark, path, "json", "doc_id bigint, text string, lang string", add_filename=True)
    return read.select("doc_id", "text", "lang", F.col(readers.FILE_NAME).endswith(".json").alias("has_file_name"))


@query
def read_json_files(spark, sf_dir):
    path = scratch_path(spark, "json")
    writers.write_documents(docs(spark, sf_dir, "doc_id", "text"), path)
    files = spark.read.schema("doc_id bigint").json(path).inputFiles()
    return readers.read_documents(spark, files, "json", "doc_id bigint, text string")


@query
def read_gzipped_json(spark, sf_dir):
    path = scratch_path(spark, "gzip")
    docs(spark, sf_dir, "doc_id", "text").write.option("compression", "gzip").json(path)
    return readers.read_documents(spark, f"{path}/*.json.gz", "json", "doc_id bigint, text string")


@query
def read_recursively(spark, sf_dir):
    path = scratch_path(spark, "nested")
    docs(spark, sf_dir, "doc_id", "lang", "source").write.partitionBy("source", "lang").parquet(path)
    return readers.read_documents(spark, path, recursive=True).select("doc_id")


@query
def read_projected_columns(spark, sf_dir):
    return readers.read_documents(spark, f"{sf_dir}/documents*.parquet", columns=["doc_id", "source"])


@query
def files_without_required_columns(spark, sf_dir):
    """The documents in four shards, one of them without its text: the shard, the column it lacks, and its rows."""
    path = scratch_path(spark, "shards")
    for k in range(4):
        shard = docs(spark, sf_dir).filter(F.col("doc_id") % 4 == k)
        (shard.drop("text") if k == 3 else shard).write.parquet(f"{path}/shard-{k}")
    found = readers.missing_columns(spark, f"{path}/*/*.parquet", ["doc_id", "text"])
    rows = spark.read.schema("doc_id bigint").parquet(f"{path}/*").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    bad = found.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(rows.agg(F.count("doc_id").alias("n_rows")), "file")
    shard = F.element_at(F.split("path", "/"), -2)
    return bad.groupBy(shard.alias("shard"), F.array_join("missing", ",").alias("missing")).agg(F.sum("n_rows").alias("n_rows"))


# --- sinks ---------------------------------------------------------------------------------------------------


@query
def write_json_per_source_file(spark, sf_dir):
    """The documents as if read from a file per source and language, and the file each one was written to.

    A large source's file comes in numbered parts; the number is taken off.
    """
    path = scratch_path(spark, "by-file")
    named = docs(spark, sf_dir, "doc_id", "text", "source", "lang").withColumn(readers.FILE_NAME, F.format_string("%s %s.json", "source", "lang"))
    writers.write_documents(named, path, write_to_filename=True)
    read = readers.read_documents(spark, path, "json", "doc_id bigint, file_name string").select("*", F.col("_metadata.file_path").alias("file"))
    written = F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"-[0-9]{5}\.json$", ".json")
    return read.select("doc_id", "file_name", written.alias("written_to"))


@query
def write_json_parts(spark, sf_dir):
    path = scratch_path(spark, "parts")
    writers.write_documents(docs(spark, sf_dir, "doc_id", "text"), path)
    return spark.read.schema("doc_id bigint, text string").json(path)


@query
def write_parquet_parts(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    writers.write_documents(docs(spark, sf_dir, "doc_id", "text"), path, "parquet")
    return spark.read.parquet(path)


@query
def separate_by_language(spark, sf_dir):
    return writers.separate_by_field(docs(spark, sf_dir, "doc_id", "text", "lang"), scratch_path(spark, "langs"), "lang")


@query
def write_equal_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    writers.write_shards(docs(spark, sf_dir), path, 8)
    shards = spark.read.parquet(path).groupBy(F.input_file_name().alias("shard")).agg(F.count("*").alias("n"))
    return shards.agg(F.count("*").alias("n_shards"), F.sum("n").alias("n_documents"))


@query
def write_train_validation_json(spark, sf_dir):
    path = scratch_path(spark, "sft")
    rows = sft.clean_pairs(pairs(spark, sf_dir))
    split = sampling.split_train_validation(rows, VAL_RATIO, ["conv_id", "turn"], SEED)
    split.select("prompt", "label", "split").write.partitionBy("split").option("ignoreNullFields", "false").json(path)
    return spark.read.schema("prompt string, label string, split string").json(path)


@query
def write_combined_text_json(spark, sf_dir):
    path = scratch_path(spark, "combined")
    text = pairs(spark, sf_dir).select(sft.combined_text(F.col("prompt"), F.col("label")).alias("text"))
    writers.write_documents(text, path)
    return spark.read.schema("text string").json(path)


@query
def prepare_prompt_label_files(spark, sf_dir):
    """The whole preparation from a parquet glob: clean, split, write, count what was written."""
    source, out = scratch_path(spark, "pairs"), scratch_path(spark, "prepared")
    pairs(spark, sf_dir).select("prompt", "label").write.parquet(source)
    return sft_data.prepare_jsonl(spark, f"{source}/*.parquet", out).groupBy().agg(F.sum("n_rows").alias("n_rows"))


@query
def combine_prompt_label_files(spark, sf_dir):
    source, out = scratch_path(spark, "pairs"), scratch_path(spark, "combined")
    pairs(spark, sf_dir).select("prompt", "label").write.parquet(source)
    sft_data.combine_jsonl(spark, f"{source}/*.parquet", out)
    return spark.read.schema("text string").json(out).select("text")


@query
def write_labelled_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    labelled = docs(spark, sf_dir).select(modify.label_prefix("__label__hq")(F.col("text")).alias("text"))
    writers.write_lines(labelled, path)
    return spark.read.text(path)


@query
def exact_duplicate_table_on_disk(spark, sf_dir):
    cache = scratch_path(spark, "cache")
    dedup.exact_duplicates(docs(spark, sf_dir), "doc_id", cache_dir=cache)
    return spark.read.parquet(f"{cache}/_exact_duplicates.parquet")


@query
def tokenized_corpus_on_disk(spark, sf_dir):
    tokens = packing.tokenize_corpus(docs(spark, sf_dir), "doc_id", end_of_document=65_536)
    return materialize(tokens, "tokens").select("doc_id", ids_as_text(F.col("tokens")).alias("tokens"), "n_tokens")


# --- projections, predicates, composition --------------------------------------------------------------------


@query
def keep_text_column(spark, sf_dir):
    return docs(spark, sf_dir, "text")


@query
def map_question_answer_columns(spark, sf_dir):
    qa = pairs(spark, sf_dir).withColumnsRenamed({"prompt": "question", "label": "answer"})
    return sft.map_columns(qa, {"question": "prompt", "answer": "label"})


@query
def unpack_language_score(spark, sf_dir):
    """Score and code out of the model's score object, each as a column."""
    scored = _languages(spark, sf_dir).withColumn("score", F.round(F.col("language")["score"], 2))
    return scored.select("doc_id", "score", classify.language_code().alias("language"))


@query
def clean_prompt_label_pairs(spark, sf_dir):
    return sft.clean_pairs(pairs(spark, sf_dir))


@query
def combined_prompt_label(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "conv_id", "turn", sft.combined_text(F.col("prompt"), F.col("label")).alias("text")
    )


@query
def score_and_filter(spark, sf_dir):
    step = compose.ScoreFilter(filters.word_count(min_words=80), score_field="word_count")
    return step(docs(spark, sf_dir)).select("doc_id", F.col("word_count").cast("bigint").alias("word_count"))


@query
def modify_text(spark, sf_dir):
    return compose.Modify(F.lower)(docs(spark, sf_dir))


def _one_space(text: str) -> str:
    return " ".join(text.split())


def _distinct_words(text: str) -> float:
    found = text.split()
    return len(set(found)) / len(found) if found else 0.0


@query
def own_text_modifier(spark, sf_dir):
    """A plain Python function from text to text as a modifier."""
    return compose.Modify(compose.python_modifier(_one_space))(docs(spark, sf_dir))


@query
def own_score_and_keep(spark, sf_dir):
    """A plain Python function from text to score as a filter, with its rule; the score goes on."""
    own = filters.python_filter("distinct_words", _distinct_words, lambda share: share >= 0.7)
    return compose.ScoreFilter(own, score_field="share")(docs(spark, sf_dir)).select("doc_id", "share")


@query
def sequential_steps(spark, sf_dir):
    steps = compose.Sequential(
        [
            compose.Modify(modify.unify_quotes_and_tags),
            compose.Sequential([compose.ScoreFilter(filters.word_count(min_words=80))]),
            lambda d: d.select("doc_id"),
        ]
    )
    return steps(docs(spark, sf_dir))


@query
def heuristic_cascade(spark, sf_dir):
    return curation.heuristic_filter(docs(spark, sf_dir)).select("doc_id")


@query
def cascade_stage_counts(spark, sf_dir):
    return filters.build_filter_cascade(curation.HEURISTICS).report(docs(spark, sf_dir))


@query
def curate_web_corpus(spark, sf_dir):
    return curation.curate_web_corpus(docs(spark, sf_dir)).select("doc_id", F.col("word_count").cast("bigint").alias("word_count"))


@query
def curate_pretraining_corpus(spark, sf_dir):
    found = curation.curate_pretraining_corpus(spark, f"{sf_dir}/documents.parquet", "HI", partitions=input_partitions(spark))
    return found.select("doc_id", "id")


# --- joins, grouping, order, sets ----------------------------------------------------------------------------


@query
def remove_listed_ids(spark, sf_dir):
    listed = load(spark, sf_dir, "labels", "doc_id", "toxic").filter("toxic = 1")
    return dedup.remove_ids(docs(spark, sf_dir, "doc_id", "lang"), listed, "doc_id")


def _line_buckets(spark, sf_dir):
    """Documents by the lines they hold: buckets whose members SQL can name as well."""
    held = F.array_distinct(lines(F.col("text")))
    return materialize(docs(spark, sf_dir).select("doc_id", F.explode(held).alias("line")), "line-buckets")


@query
def bucket_star_edges(spark, sf_dir):
    edges = fuzzy.bucket_edges(_line_buckets(spark, sf_dir), "doc_id", key=["line"])
    return edges.select("src", "dst").distinct()


@query
def document_counts_by_stage(spark, sf_dir):
    cascade = filters.FilterCascade([filters.word_count(min_words=80), filters.complete_document()])
    return cascade.report(docs(spark, sf_dir))


@query
def documents_per_language(spark, sf_dir):
    return curation.documents_per_language(docs(spark, sf_dir, "doc_id", "text", "lang"))


@query
def documents_per_language_in_stages(spark, sf_dir):
    folder = scratch_path(spark, "stages")
    return curation.documents_per_language_in_stages(spark, docs(spark, sf_dir, "doc_id", "text", "lang"), folder)


@query
def language_counts(spark, sf_dir):
    return docs(spark, sf_dir, "lang").groupBy("lang").agg(F.count("*").alias("n_documents"))


@query
def validation_report(spark, sf_dir):
    return sft.validation_report(pairs(spark, sf_dir), SEQ_LENGTH)


@query
def split_row_counts(spark, sf_dir):
    split = sampling.split_train_validation(sft.clean_pairs(pairs(spark, sf_dir)), VAL_RATIO, ["conv_id", "turn"], SEED)
    return split.groupBy("split").agg(F.count("*").alias("n_rows"))


@query
def token_budget(spark, sf_dir):
    tokens = packing.tokenize_corpus(docs(spark, sf_dir), "doc_id", end_of_document=65_536)
    return packing.token_budget(tokens, 16, SEQ_LENGTH)


@query
def rows_beyond_first(spark, sf_dir):
    keyed = docs(spark, sf_dir, "doc_id", "lang", "source").select("doc_id", F.concat_ws("/", "lang", "source").alias("part"))
    return dedup.beyond_first(materialize(keyed, "keyed"), "part", "doc_id")


@query
def add_sequential_id(spark, sf_dir):
    return ordinals.add_id(docs(spark, sf_dir, "doc_id", "lang"), "doc_id", "id", "FR_data").select("doc_id", "id")


@query
def add_id_by_position(spark, sf_dir):
    return ordinals.add_id_by_position(spark, f"{sf_dir}/documents.parquet", "id", "HI", 100).select("doc_id", "id")


def _offsets(spark, sf_dir):
    tokens = packing.tokenize_corpus(docs(spark, sf_dir), "doc_id", end_of_document=65_536)
    return packing.token_offsets(materialize(tokens.select("doc_id", "n_tokens"), "lengths"), "doc_id")


@query
def packed_sample_lengths(spark, sf_dir):
    return packing.sample_lengths(_offsets(spark, sf_dir), SEQ_LENGTH)


@query
def packed_samples(spark, sf_dir):
    tokens = packing.tokenize_corpus(docs(spark, sf_dir), "doc_id", end_of_document=65_536)
    packed = packing.pack_samples(tokens, SEQ_LENGTH, "doc_id")
    return packed.select("sample", ids_as_text(F.col("tokens")).alias("tokens"))


@query
def contiguous_split(spark, sf_dir):
    shares = {"train": 0.995, "validation": 0.005, "test": 0.0}
    return ordinals.split_by_order(docs(spark, sf_dir, "doc_id"), shares, "doc_id")


@query
def head_of_corpus(spark, sf_dir):
    return sampling.head(docs(spark, sf_dir, "doc_id", "lang", "source"), 3, "doc_id")


@query
def sorted_input_files(spark, sf_dir):
    """The documents in named shards: each row's shard and its place in sorted file order."""
    path = scratch_path(spark, "shards")
    sharded = docs(spark, sf_dir, "doc_id").withColumn("shard", F.format_string("shard-%02d", F.col("doc_id") % 3))
    ordered = sharded.repartitionByRange(4, "shard", "doc_id").sortWithinPartitions("shard", "doc_id")
    ordered.withColumn("folder", F.col("shard")).write.partitionBy("folder").parquet(path)
    return ordinals.read_with_position(spark, path, "place").select("doc_id", "shard", "place")


@query
def row_at_global_index(spark, sf_dir):
    return ordinals.row_at(spark, f"{sf_dir}/documents.parquet", 123).select("doc_id", "text", "ordinal")


@query
def shuffled_corpus(spark, sf_dir):
    return sampling.shuffle(docs(spark, sf_dir, "doc_id", "source"), "doc_id", SEED)


@query
def sample_about_n(spark, sf_dir):
    return sampling.sample_about(docs(spark, sf_dir, "doc_id", "lang"), 100, "doc_id", SEED)


@query
def sample_exactly_n(spark, sf_dir):
    return sampling.sample_exactly(docs(spark, sf_dir, "doc_id", "lang"), 100, "doc_id", SEED)


@query
def first_n_documents(spark, sf_dir):
    return sampling.first_n(docs(spark, sf_dir, "doc_id", "lang"), 150, "doc_id")


@query
def sample_exactly_a_third(spark, sf_dir):
    corpus = docs(spark, sf_dir, "doc_id", "lang")
    return sampling.sample_exactly(corpus, corpus.count() // 3, "doc_id", SEED)


@query
def pick_among_first_valid(spark, sf_dir):
    valid = sft.clean_pairs(pairs(spark, sf_dir)).withColumn("row", F.col("conv_id") * 1000 + F.col("turn"))
    return sampling.pick_among_first(valid, 20, "row", SEED).select("conv_id", "turn", "prompt", "label")


@query
def capped_validation_samples(spark, sf_dir):
    tokens = _offsets(spark, sf_dir)
    return sampling.first_n(packing.sample_lengths(tokens, SEQ_LENGTH), 64, "sample")


@query
def bernoulli_split(spark, sf_dir):
    return sampling.split_train_validation(docs(spark, sf_dir, "doc_id"), VAL_RATIO, ["doc_id"], SEED)


@query
def union_of_corpora(spark, sf_dir):
    return sampling.union_corpora(docs(spark, sf_dir, "text"), load(spark, sf_dir, "benchmark", "text"))


@query
def every_sample_twice(spark, sf_dir):
    return sampling.duplicate_samples(docs(spark, sf_dir, "doc_id", "lang"))


# --- filters -------------------------------------------------------------------------------------------------


def _filter_query(name: str, filt: filters.TextFilter) -> None:
    def run(spark, sf_dir):
        scored = filters.FilterCascade([filt]).scores(docs(spark, sf_dir)).drop("text")
        kept = F.coalesce(filt.keep(F.col(filt.name)), F.lit(False))
        return scored.select("doc_id", F.col(filt.name).cast("double").alias("score"), kept.alias("kept"))

    register(name, run)


for _f in (
    filters.word_count(min_words=80),
    filters.complete_document(),
    filters.symbols_to_words(),
    filters.numbers(),
    filters.urls(),
    filters.white_space(),
    filters.parentheses(),
    filters.boilerplate(),
    filters.unique_lines(),
    filters.unique_paragraphs(),
    filters.unique_line_chars(),
    filters.unique_paragraph_chars(),
    filters.punctuation(),
    filters.mean_word_length(),
    filters.long_word(),
    filters.ellipsis(),
    filters.bullets(),
):
    _filter_query(f"filter_{_f.name}", _f)


def _odd_texts(spark, sf_dir):
    """Texts with URLs, bullets, ellipses, boilerplate and paragraphs, made of every page, whole, and conversation turn."""
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    said = load(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    line = F.regexp_replace(F.regexp_replace("html", BLOCK_TAG, "\n\n"), "<[^>]*>", " ")  # blocks are paragraphs
    note = F.element_at(F.array(*map(F.lit, ("We use cookies.", "Lorem ipsum dolor.", "Plain end.", "See our Privacy Policy"))), (F.col("page_id") % 4 + 1).cast("int"))
    page = F.concat_ws("\n\n", F.concat(F.lit("* "), "url"), line, F.when(F.col("page_id") % 3 == 0, line), F.concat(F.lit("- see http://"), F.col("page_id"), F.lit(".org ...")), note)
    turn = F.concat_ws("\n", F.concat(F.lit("• "), F.regexp_replace("text", "\n", " ")), F.when(F.col("turn") % 2 == 0, F.lit("and so on…")), F.lit("www.example.org/x"))
    rows = pages.select((F.col("page_id") * 1000 + 999).alias("doc_id"), page.alias("text"))
    return rows.unionByName(said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), turn.alias("text")))


def _odd_filter_query(filt: filters.TextFilter) -> None:
    def run(spark, sf_dir):
        scored = filters.FilterCascade([filt]).scores(_odd_texts(spark, sf_dir)).drop("text")
        kept = F.coalesce(filt.keep(F.col(filt.name)), F.lit(False))
        return scored.select("doc_id", F.col(filt.name).cast("double").alias("score"), kept.alias("kept"))

    register(f"filter_{filt.name}_on_pages", run)


for _f in (filters.urls(), filters.boilerplate(), filters.unique_paragraphs(), filters.unique_paragraph_chars(), filters.ellipsis(), filters.bullets()):
    _odd_filter_query(_f)


def _ngram_scores(spark, sf_dir, group: list[filters.TextFilter]):
    scored = filters.FilterCascade(group).scores(docs(spark, sf_dir))
    rows = [F.struct(F.lit((f.top_ns or f.dup_ns)[0]).alias("n"), F.col(f.name).alias("score")) for f in group]
    return scored.select("doc_id", F.inline(F.array(*rows)))


@query
def filter_top_ngrams(spark, sf_dir):
    return _ngram_scores(spark, sf_dir, [filters.top_ngram(n, 1.0) for n in TOP_NS])


@query
def filter_duplicate_ngrams(spark, sf_dir):
    return _ngram_scores(spark, sf_dir, [filters.duplicate_ngram(n, 1.0) for n in DUP_NS])


@query
def split_sentences(spark, sf_dir):
    """Every sentence of every document with its place."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))


# --- modifiers, tokens, loss mask ----------------------------------------------------------------------------


@query
def unify_quotes_and_tags(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", modify.unify_quotes_and_tags(F.col("html")).alias("text"))


@query
def remove_urls(spark, sf_dir):
    pages = load(spark, sf_dir, "pages", "page_id", "url")
    said = F.concat(F.lit("see\t"), F.col("url"), F.lit(" ‘now’"))
    return pages.select("page_id", modify.unify_quotes_and_tags(said).alias("text"))


@query
def repair_misread_documents(spark, sf_dir):
    """Every document, with a sentence in three scripts, read as Latin-1 once (odd ids) or twice, and repaired."""
    corpus = docs(spark, sf_dir, "doc_id", "text")
    misread = F.concat("text", F.lit(THREE_SCRIPTS))
    once = F.decode(F.encode(misread, "UTF-8"), "ISO-8859-1")
    twice = F.decode(F.encode(once, "UTF-8"), "ISO-8859-1")
    damaged = corpus.withColumn("text", F.when(F.col("doc_id") % 2 == 1, once).otherwise(twice))
    return compose.Modify(modify.reformat_unicode)(damaged)


@query
def reformat_unicode(spark, sf_dir):
    """Entities of the pages' plain text."""
    pages = load(spark, sf_dir, "pages", "page_id", "html")
    plain = F.regexp_replace("html", "[<>]", " ")
    return pages.select("page_id", modify.reformat_unicode(plain).alias("text"))


@query
def label_prefix(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", modify.label_prefix("__label__lq")(F.col("text")).alias("text"))


@query
def chat_turn_template(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "conv_id", "turn",
        modify.user_turn(F.col("prompt")).alias("user_part"),
        modify.chat_turns(F.col("prompt"), F.col("label")).alias("full_text"),
    )


def _token_pairs(spark, sf_dir):
    return sft.tokenize_pairs(sft.clean_pairs(pairs(spark, sf_dir)))


@query
def tokenize_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ids_as_text(hashed_tokens()(F.col("text"))).alias("ids"))


@query
def answer_only_loss_mask(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("conv_id", "turn", ids_as_text(F.col("labels")).alias("labels"))


@query
def truncate_and_pad(spark, sf_dir):
    rows = _token_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        sft.truncate(F.col("input_ids"), SEQ_LENGTH).alias("input_ids"),
        sft.truncate(F.col("labels"), SEQ_LENGTH).alias("labels"),
    )
    padded = sft.pad_batches(ordinals.with_ordinal(rows, ["conv_id", "turn"]), "ordinal", 8)
    return padded.select(
        "conv_id", "turn", "batch", ids_as_text(F.col("input_ids")).alias("input_ids"), ids_as_text(F.col("labels")).alias("labels")
    )


@query
def over_length_flag(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select(
        "conv_id", "turn", sft.over_length(F.col("input_ids"), SEQ_LENGTH).alias("over_length")
    )


# --- personal data -------------------------------------------------------------------------------------------


@query
def pii_spans(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", F.col("text"), pii.analyze(F.col("text"), PII_TYPES).alias("spans"))
    rows = found.select("doc_id", "text", F.inline("spans"))
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("doc_id", "type", "start", "end", "score", value.alias("value"))


@query
def pii_redaction(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pii.redact(F.col("text"), PII_TYPES).alias("text"))


@query
def pii_redaction_of_persons(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pii.redact(F.col("text"), ["PERSON"]).alias("text"))


@query
def pii_redaction_of_all_types(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pii.redact(F.col("text")).alias("text"))


# --- classifiers ---------------------------------------------------------------------------------------------


def _by_other_half(df: DataFrame, train: Callable[[DataFrame], CharacterModel], predict: Callable[[DataFrame, CharacterModel], DataFrame]) -> DataFrame:
    """Each half is predicted by a model trained on the other, so every row gets a prediction of texts not seen."""
    first = F.coalesce(hash_unit("half", "doc_id") < 0.5, F.lit(False))
    one, other = df.filter(first), df.filter(~first)
    return predict(other, train(one)).unionByName(predict(one, train(other)))


def _languages(spark, sf_dir):
    known = docs(spark, sf_dir, "doc_id", "text", "lang")
    return _by_other_half(known, classify.train_language_model, lambda rest, model: classify.identify_language(rest.select("doc_id", "text"), model))


@query
def identify_language(spark, sf_dir):
    """Every document by the model of the half that it is not in."""
    return _languages(spark, sf_dir).select("doc_id", classify.language_code().alias("language"))


@query
def drop_unsure_language(spark, sf_dir):
    """Each text as it is and in a script the model has not seen; the least score drops the latter.

    A short text is dropped only where it is mostly of n-grams that its language has not shown.
    """

    def sure(rest, model):
        own = rest.select("doc_id", "text", F.lit(False).alias("foreign"))
        letters = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
        foreign = own.select("doc_id", F.regexp_replace(letters, "[^а-я]", "я").alias("text"), F.lit(True).alias("foreign"))
        return classify.identify_language(own.unionByName(foreign), model, min_score=MIN_LANGUAGE_SCORE)

    scored = _by_other_half(docs(spark, sf_dir, "doc_id", "text", "lang"), classify.train_language_model, sure)
    return scored.select("doc_id", "foreign", classify.language_code().alias("language"))


@query
def classify_domain(spark, sf_dir):
    """Domains that the words of a text tell; every document by the model of the half that it is not in."""
    names = F.create_map(*[F.lit(x) for pair in DOMAIN_OF_LANGUAGE.items() for x in pair])
    known = docs(spark, sf_dir, "doc_id", "text", "lang").withColumn("domain", names[F.col("lang")])
    scored = _by_other_half(known, classify.train_domain_model, lambda rest, model: classify.classify_domain(rest.select("doc_id", "text"), model))
    return scored.select("doc_id", "domain_pred")


def _by_quality(spark, sf_dir):
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    # Read for the counts and the samples of both classes, so joined and written once.
    return materialize(docs(spark, sf_dir).join(labels, "doc_id"), "graded")


def _training_set(spark, sf_dir, n=200):
    graded = _by_quality(spark, sf_dir)
    return classify.quality_training_set(graded.filter("quality = 1"), graded.filter("quality = 0"), n, "doc_id", seed=SEED)


@query
def quality_training_set(spark, sf_dir):
    return _training_set(spark, sf_dir)


@query
def quality_scores(spark, sf_dir):
    lines_ = _training_set(spark, sf_dir, 100_000).select(F.col("text").alias("value"))
    # A higher rate than for a sample of 100,000 a class, as the tables hold fewer labels.
    model = classify.train_quality_model(classify.read_training_lines(lines_), lr=1.0, dim=100, epoch=5, word_ngrams=2)
    return classify.score_quality(docs(spark, sf_dir), model).select("doc_id", F.round("quality_score", 6).alias("quality_score"))


@query
def keep_by_quality_draw(spark, sf_dir):
    """The keep rule on a score that SQL has as well: the share of distinct lines."""
    scored = filters.FilterCascade([filters.unique_lines()]).scores(docs(spark, sf_dir))
    scored = scored.withColumn("quality_score", F.col("unique_lines") * hash_unit("q", "doc_id"))
    return classify.keep_by_quality(scored, "doc_id", 9.0, seed=SEED).select("doc_id", "quality_score")


@query
def keep_by_quality_threshold(spark, sf_dir):
    scored = filters.FilterCascade([filters.unique_lines()]).scores(docs(spark, sf_dir))
    return classify.keep_by_quality(scored, "doc_id", threshold=0.9, score_field="unique_lines").select("doc_id", "unique_lines")


# --- deduplication -------------------------------------------------------------------------------------------


@query
def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(docs(spark, sf_dir), "doc_id")


@query
def exact_duplicates_to_remove(spark, sf_dir):
    return dedup.exact_duplicates_to_remove(docs(spark, sf_dir), "doc_id")


@query
def remove_exact_duplicates(spark, sf_dir):
    return dedup.remove_exact_duplicates(docs(spark, sf_dir, "doc_id", "text", "lang"), "doc_id").select("doc_id", "lang")


FUZZY = fuzzy.FuzzyConfig(id_field="doc_id")


@query
def minhash_signatures(spark, sf_dir):
    return fuzzy.signatures(docs(spark, sf_dir), FUZZY).select("doc_id", F.md5(ids_as_text(F.col("signature"))).alias("signature"))


@query
def lsh_buckets(spark, sf_dir):
    return fuzzy.lsh_buckets(fuzzy.signatures(docs(spark, sf_dir), FUZZY), FUZZY)


@query
def lsh_edges(spark, sf_dir):
    return fuzzy.fuzzy_edges(docs(spark, sf_dir), FUZZY)


@query
def components_of_shared_lines(spark, sf_dir):
    edges = fuzzy.bucket_edges(_line_buckets(spark, sf_dir), "doc_id", key=["line"])
    return connected_components(edges, id_field="doc_id")


@query
def fuzzy_duplicates(spark, sf_dir):
    return fuzzy.fuzzy_duplicates(docs(spark, sf_dir), FUZZY)


@query
def remove_fuzzy_duplicates(spark, sf_dir):
    return fuzzy.remove_fuzzy_duplicates(docs(spark, sf_dir), FUZZY).select("doc_id")


@query
def edge_similarity(spark, sf_dir):
    corpus = docs(spark, sf_dir)
    edges = materialize(fuzzy.bucket_edges(_line_buckets(spark, sf_dir), "doc_id", key=["line"]), "edges")
    return fuzzy.edge_similarity(edges, corpus, FUZZY)


@query
def confirmed_fuzzy_duplicates(spark, sf_dir):
    config = fuzzy.FuzzyConfig(id_field="doc_id", false_positive_check=True)
    return fuzzy.fuzzy_duplicates(docs(spark, sf_dir), config)


@query
def contaminated_positions(spark, sf_dir):
    return decontaminate.contaminated_positions(
        docs(spark, sf_dir), load(spark, sf_dir, "benchmark", "text"), id_field="doc_id"
    ).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_words").cast("bigint").alias("n_words"))


@query
def remove_contaminated_documents(spark, sf_dir):
    benchmark = load(spark, sf_dir, "benchmark", "text")
    return decontaminate.remove_contaminated_documents(docs(spark, sf_dir), benchmark, id_field="doc_id").select("doc_id")


@query
def remove_contaminated_sections(spark, sf_dir):
    benchmark = load(spark, sf_dir, "benchmark", "text")
    return decontaminate.remove_contaminated_sections(docs(spark, sf_dir), benchmark, id_field="doc_id")
