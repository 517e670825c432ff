"""Time the headline queries; prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gleaner.plans.catalog import QUERIES
from gleaner.session import get_session

HEADLINE = [
    "documents_per_language", "heuristic_cascade", "cascade_stage_counts", "filter_top_ngrams", "filter_duplicate_ngrams",
    "curate_web_corpus", "curate_pretraining_corpus", "unify_quotes_and_tags", "reformat_unicode", "pii_spans", "pii_redaction",
    "exact_duplicates", "remove_exact_duplicates", "minhash_signatures", "lsh_edges", "fuzzy_duplicates",
    "remove_fuzzy_duplicates", "contaminated_positions", "remove_contaminated_sections", "identify_language",
    "quality_scores", "add_sequential_id", "add_id_by_position", "tokenize_texts", "packed_samples", "validation_report",
    "answer_only_loss_mask", "write_train_validation_json", "separate_by_language",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {} if os.environ.get("BENCH_CHECKPOINT") is None else {"spark__checkpoint__dir": os.environ["BENCH_CHECKPOINT"]}
    spark = get_session(
        "gleaner-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__gleaner__inputPartitions=cpus,  # one small file per table, of one row group
        **({"spark__checkpoint__dir": tempfile.mkdtemp(prefix="gleaner-")} | settings),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the JVM's and the Python workers' machinery before the clock runs.
    QUERIES["filter_top_ngrams"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in list(QUERIES) if names == ["all"] else names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the other queries' times are still wanted
            errors[name] = f"{type(error).__name__}: {str(error)[:300]}"
            continue
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf} | ({"errors": errors} if errors else {})))
    spark.stop()
    sys.exit(bool(errors))


if __name__ == "__main__":
    main()
