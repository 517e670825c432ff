"""Quality rules: counts per text and a calibrated classifier with fixed thresholds.

The counts catch texts that are too short or repeat themselves.  What they pass is judged by a logistic regression over
hashed words, pairs of words and character n-grams, fitted on labelled rows, calibrated (Platt) on a fifth of them and
scored in Arrow batches.  A text is kept when its probability of good quality is at least ``threshold``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from gleaner.llm.frames import unused
from gleaner.llm.textmodel import Features, Model, labelled_sample, train
from gleaner.llm.words import SPACE, cut_words, parts, texts_of, windows

FEATURES = Features(letters_only=False, chars=(2, 3, 4), prefixes=False, words=(1, 2), bits=18)
MAX_ROWS = 4_000
THRESHOLD = 0.5
MIN_WORDS = 10
MAX_REPEATED_PER_CENT = 20
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT_TYPE = StructType(
    [StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("quality", DoubleType()), StructField("kept", BooleanType())]
)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the texts; a null text is empty."""
    data, bounds = texts_of(column)
    n = len(column)
    words = cut_words(data, bounds, SPACE)
    first = words.first(n)
    starts_char = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": per_text(starts_char & ~SPACE[data], bounds), "n_symbols": per_text(_SYMBOL[data], bounds)}
    raw = data.tobytes()
    dup = np.zeros(n, np.int64)
    for i in np.flatnonzero(per_text(data == 10, bounds)).tolist():
        lines = [line for line in raw[bounds[i] : bounds[i + 1]].split(b"\n") if line and not line.isspace()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    at, hashes = windows(words, WINDOW)
    order = np.lexsort((hashes, words.text[at]))
    h, t = hashes[order], words.text[at][order]
    same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    again = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    step = np.zeros(len(words.hashes) + 1, np.int64)
    step[again] += 1
    np.add.at(step, again + WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(step[:-1]) > 0, first)
    return out


def judge(column: pa.Array, model: Model, threshold: float) -> pa.StructArray:
    found = counts(column)
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED_PER_CENT * found["n_words"])
    quality = model.score(column)
    arrays = [pa.array(found[c], pa.int64()) for c in COUNTS]
    return pa.StructArray.from_arrays([*arrays, pa.array(failed), pa.array(quality, pa.float64()), pa.array(~failed & (quality >= threshold))], [f.name for f in VERDICT_TYPE])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, l2: float = 1e-6, features: Features = FEATURES) -> Model:
    """Fit on at most ``max_rows`` of the documents that ``labels`` marks with 0 or 1, those with the smallest hash of the id."""
    return train(labelled_sample(docs.filter("text IS NOT NULL"), labels, label, max_rows), features, l2)


def judge_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, out: str = "verdict") -> DataFrame:
    """``docs`` with a struct column ``out`` of the counts, ``base_failed``, ``quality`` and ``kept``.

    A null or empty text has no words and so fails.  Every row stays; repeated rows get the same verdict.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        chunks = [judge(part.column("text"), shared.value, threshold) for part in parts(pa.record_batch([column], ["text"]), limit=1 << 20)]
        return pa.concat_arrays(chunks) if chunks else judge(column, shared.value, threshold)

    return docs.withColumn(out, F.arrow_udf(run, VERDICT_TYPE).asNondeterministic()("text"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with their own columns."""
    (verdict,) = unused(docs, "verdict")
    return judge_quality(docs, model, threshold, verdict).filter(F.col(verdict)["kept"]).drop(verdict)
