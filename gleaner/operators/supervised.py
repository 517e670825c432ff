"""A supervised text classifier: averaged n-gram embeddings with a softmax (Joulin et al. 2016), trained by tasks.

A text's features are its words and runs of up to ``word_ngrams`` words, hashed into ``buckets``.  Their embeddings, ``dim`` numbers
each, are averaged, and a linear layer gives each label's share.  The labelled sample is dealt out by hash into parts of
bounded size.  In an epoch every part goes through stochastic gradient steps from the same parameters, the rate falling from
``lr`` to 0 over all epochs; then a feature's embedding becomes the mean over the parts that met it, and the layer the mean over
all.  Parts, their order and the start depend on the rows alone, so the same sample gives the same model on any cluster.

What scoring needs is one weight per feature and label, the product of embedding and layer: a table that SQL can read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.slices import by_slices, list_array, text_slices
from gleaner.session import discard, materialize, scratch_path

PART_ROWS = 1024
MAX_NUMBERS = 1 << 26  # embeddings in memory, 256 MB
FEATURE_BLOCK = 4096


def features(text: str | None, word_ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text, ascending, and how often each occurs."""
    words = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    grams = [crc32(w) for w in words]
    found = list(grams)
    for n in range(1, word_ngrams):
        grams = [crc32(words[i + n], crc32(b" ", g)) for i, g in enumerate(grams[: len(words) - n])]
        found += grams
    return np.unique(np.array(found, np.int64) % buckets, return_counts=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class TextModel:
    """``weights``: per feature and label, nan where no training text had the feature."""

    labels: Sequence[str]
    weights: np.ndarray
    word_ngrams: int

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        """The labels' shares of each text; equal ones where it has no known feature."""
        sums = np.zeros((len(texts), len(self.labels)))
        known = ~np.isnan(self.weights[:, 0])
        for i, text in enumerate(texts):
            feature, count = features(text, self.word_ngrams, len(self.weights))
            feature, count = feature[known[feature]], count[known[feature]]
            if len(feature):
                sums[i] = count @ self.weights[feature] / count.sum()
        return _softmax(sums)

    def predict(self, df: DataFrame, label: str, text_field: str, into: str) -> DataFrame:
        """``df`` with the share of ``label`` in ``into``."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # features times labels
        place = list(self.labels).index(label)

        share = by_slices(lambda texts: pa.array(shared.value.probabilities(texts)[:, place]), "double")
        return df.withColumn(into, share(F.coalesce(F.col(text_field), F.lit(""))))

    def table(self, spark: SparkSession) -> DataFrame:
        """``(feature, label, weight)`` of every known feature."""
        known = np.flatnonzero(~np.isnan(self.weights[:, 0]))
        rows = pd.DataFrame(self.weights[known], columns=list(self.labels)).assign(feature=known)
        return spark.createDataFrame(rows.melt("feature", var_name="label", value_name="weight"), "feature long, label string, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/weights")
        about = json.dumps({"labels": list(self.labels), "buckets": len(self.weights), "word_ngrams": self.word_ngrams})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        weights = np.full((about["buckets"], len(about["labels"])), np.nan)
        rows = spark.read.parquet(f"{path}/weights").toPandas()
        weights[rows["feature"].to_numpy(), rows["label"].map({x: i for i, x in enumerate(about["labels"])}).to_numpy()] = rows["weight"]
        return cls(about["labels"], weights, about["word_ngrams"])


def start(buckets: int, dim: int, n_labels: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Small random embeddings and a layer of zeros."""
    embeddings = np.random.default_rng(seed).uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    return embeddings, np.zeros((n_labels, dim), np.float32)


def steps(embeddings: np.ndarray, layer: np.ndarray, rows: Sequence[tuple[int, np.ndarray, np.ndarray]], rate: float, fall: float) -> None:
    """One gradient step per row ``(label, features, counts)``, in place, the rate falling by ``fall`` over the rows."""
    for i, (label, feature, count) in enumerate(rows):
        if not len(feature):
            continue
        lr = np.float32(rate - fall * i / len(rows))
        share = (count / count.sum()).astype(np.float32)
        held = embeddings[feature]
        mean = share @ held
        error = _softmax(layer @ mean).astype(np.float32)
        error[label] -= 1
        back = error @ layer
        layer -= lr * np.outer(error, mean)
        embeddings[feature] = held - lr * share[:, None] * back


def mean_task(dim: int, n_labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by block and part: the mean of each block's embeddings, and of the layer, block -1.

    A block is added up as its rows come, so a task holds one block's sums whatever the number of parts.
    """

    def done(block: int, total: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(times)
        averaged = (total[at] / times[at, None]).astype(np.float32)
        used = at + block * FEATURE_BLOCK if block >= 0 else at[:0]
        return pa.record_batch([pa.array([block], pa.int32()), pa.array([used.tobytes()]), pa.array([averaged.tobytes()])], ["block", "used", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, times = None, np.zeros((0, dim)), np.zeros(0, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                at_block, used, numbers = (batch.column(c)[row] for c in ("block", "used", "numbers"))
                if at_block.as_py() != block:
                    if block is not None:
                        yield done(block, total, times)
                    block = at_block.as_py()
                    size = FEATURE_BLOCK if block >= 0 else n_labels
                    total, times = np.zeros((size, dim)), np.zeros(size, np.int64)
                at = np.frombuffer(used.as_buffer(), np.int64) - block * FEATURE_BLOCK if block >= 0 else np.arange(n_labels)
                total[at] += np.frombuffer(numbers.as_buffer(), np.float32).reshape(-1, dim)
                times[at] += 1
        if block is not None:
            yield done(block, total, times)

    return run


def train_supervised(
    df: DataFrame,
    text_field: str = "text",
    label_field: str = "label",
    lr: float = 0.01,
    dim: int = 100,
    epoch: int = 5,
    word_ngrams: int = 2,
    buckets: int = 1 << 16,
    seed: int = 0,
    part_rows: int = PART_ROWS,
) -> TextModel:
    """Train on a labelled sample.  Rows without a label are left out, a null text is empty and teaches nothing.

    The sample may be of any size; the parameters, ``buckets`` times ``dim`` numbers, are held by the driver and each task, and are
    limited to MAX_NUMBERS.
    """
    if buckets * dim > MAX_NUMBERS or min(buckets, dim, word_ngrams) < 1 or epoch < 0:
        raise ValueError(f"at least one bucket, number and word, and at most {MAX_NUMBERS} numbers")
    spark = df.sparkSession
    labelled = df.filter(F.col(label_field).isNotNull()).select(F.col(label_field).cast("string").alias("label"), F.col(text_field).alias("text"))
    labels = sorted(r["label"] for r in labelled.select("label").distinct().limit(MAX_NUMBERS // dim + 1).collect())
    if not labels or len(labels) * max(buckets, dim) > MAX_NUMBERS:
        raise ValueError("too few labels, or too many for weights in memory")
    numbers = {x: i for i, x in enumerate(labels)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column("text")):
                part = batch.slice(done, len(texts))
                done += len(texts)
                found = [features(t, word_ngrams, buckets) for t in texts.to_pylist()]
                label = pa.array([numbers[x] for x in part.column("label").to_pylist()], pa.int32())
                cells = [list_array([f[k] for f in found], pa.int64()) for k in (0, 1)]
                yield pa.record_batch([part.column("place"), label, *cells], ["place", "label", "features", "counts"])

    path = scratch_path(spark, "training")
    # A sample of few files is cut by all cores.
    placed = labelled.withColumn("place", F.xxhash64("label", "text")).repartition(spark.sparkContext.defaultParallelism)
    sample = materialize(placed.mapInArrow(cut, "place long, label int, features array<long>, counts array<long>"), "training", path)
    parts = max(1, -(-sample.count() // part_rows))
    # So many partitions as asked for: the engine would join parts of few bytes into one task.
    sample = sample.withColumn("part", F.pmod(F.col("place"), F.lit(parts))).repartition(parts, "part")
    embeddings, layer = start(buckets, dim, len(labels), seed)
    met = np.zeros(buckets, bool)
    for turn in range(epoch):
        shared = spark.sparkContext.broadcast((embeddings, layer))  # limited by MAX_NUMBERS
        rate = lr * (1 - turn / epoch)

        def one_part(rows: pd.DataFrame) -> pd.DataFrame:
            mine, top = shared.value[0].copy(), shared.value[1].copy()
            rows = rows.assign(key=[f.tobytes() for f in rows["features"]]).sort_values(["place", "label", "key"])
            listed = [(label, np.asarray(f), np.asarray(c)) for label, f, c in zip(rows["label"], rows["features"], rows["counts"])]
            steps(mine, top, listed, rate, lr / epoch)
            used = np.unique(np.concatenate([f for _, f, _ in listed])).astype(np.int64)
            out = [(-1, int(rows["part"].iloc[0]), b"", top.tobytes())]
            for block in np.unique(used // FEATURE_BLOCK):
                some = used[used // FEATURE_BLOCK == block]
                out.append((int(block), int(rows["part"].iloc[0]), some.tobytes(), mine[some].tobytes()))
            return pd.DataFrame(out, columns=["block", "part", "used", "numbers"])

        moved = sample.groupBy("part").applyInPandas(one_part, "block int, part long, used binary, numbers binary")
        # One part after the other: all that parts found for a block are more than a worker should hold.
        ordered = moved.repartition("block").sortWithinPartitions("block", "part")
        averaged = ordered.mapInArrow(mean_task(dim, len(labels)), "block int, used binary, numbers binary")
        embeddings, layer = embeddings.copy(), layer.copy()
        for row in averaged.collect():  # as many numbers as the parameters have
            numbers_ = np.frombuffer(row["numbers"], np.float32).reshape(-1, dim)
            if row["block"] < 0:
                layer = numbers_.copy()
            else:
                used = np.frombuffer(row["used"], np.int64)
                embeddings[used] = numbers_
                met[used] = True
        shared.unpersist()
    discard(spark, path)
    weights = (embeddings @ layer.T).astype(np.float64)
    weights[~met] = np.nan
    return TextModel(labels, weights, word_ngrams)
