"""Text classifiers: language, domain and quality, trained and applied on the cluster.

A model is any function that adds a prediction to a DataFrame, so a user's own model can stand in.  Language and
domain use naive Bayes over hashed character n-grams, counted per task and summed by a grouping; quality uses
averaged word n-gram embeddings (``supervised.py``).  The size of a model is set by its parameters and the number of labels,
not by the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.charmodel import PSEUDO, CharacterModel, grams, runs
from gleaner.functions.modify import label_prefix
from gleaner.functions.text import hash_unit
from gleaner.operators.sampling import sample_about
from gleaner.operators.supervised import TextModel, train_supervised
from gleaner.session import materialize, written_with_row_id

# The domain names.
DOMAINS = [
    "Arts_and_Entertainment", "Autos_and_Vehicles", "Adult", "Beauty_and_Fitness", "Books_and_Literature",
    "Business_and_Industrial", "Computers_and_Electronics", "Finance", "Food_and_Drink", "Games", "Health",
    "Hobbies_and_Leisure", "Home_and_Garden", "Internet_and_Telecom", "Jobs_and_Education", "Law_and_Government",
    "News", "Online_Communities", "People_and_Society", "Pets_and_Animals", "Real_Estate", "Science",
    "Sensitive_Subjects", "Shopping", "Sports", "Travel_and_Transportation",
]

BLOCK_WEIGHTS = 1 << 24  # weights held at a time, 64 MB
_HELD_LABELS = 64  # labels whose counts a task holds before it passes them on


@dataclass
class LabelTable:
    """A model with more weights than are held at a time: the counts as a written table ``(number, feature, n)``.

    The driver holds a name, a number of texts and a number of n-grams for each label.
    """

    counts: DataFrame
    labels: list[str]
    texts: np.ndarray
    totals: np.ndarray
    features: int
    ns: Sequence[int]
    block_weights: int

    def blocks(self) -> Iterator[tuple[int, CharacterModel]]:
        """The first label's number and the model of every block of labels, with probabilities among all labels."""
        width = max(1, self.block_weights // self.features)
        for low in range(0, len(self.labels), width):
            names = self.labels[low : low + width]
            rows = self.counts.filter(F.col("number").between(low, low + len(names) - 1)).toPandas()  # a block's weights at most
            table = np.ones((self.features, len(names)))
            table[rows["feature"].to_numpy(np.int64), rows["number"].to_numpy(np.int64) - low] += rows["n"].to_numpy(np.int64)
            logs = np.log(table / (self.totals[low : low + width] + self.features)).astype(np.float32)
            yield low, CharacterModel(names, np.log(self.texts[low : low + width] / self.texts.sum()), logs, self.ns)


def _predict_by_blocks(model: LabelTable, df: DataFrame, text_field: str) -> DataFrame:
    """One pass over the texts' n-gram counts per block of labels; each writes a narrow row per text.

    The rows are written once with a number of their own, to which the results come back.
    """
    rows, uid = written_with_row_id(df, "labelled-rows")
    width, ns = model.features, tuple(model.ns)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = [gram for _, gram in grams([text], ns, width)]
                out.append(np.unique(np.concatenate(found), return_counts=True))
            yield pd.DataFrame({"uid": batch["uid"], "features": [f for f, _ in out], "counts": [c for _, c in out]})

    texts = rows.select(F.col(uid).alias("uid"), F.coalesce(F.col(text_field), F.lit("")).alias("text"))
    table = materialize(texts.mapInPandas(counted, "uid long, features array<long>, counts array<long>"), "label-features")
    parts = []
    for low, block in model.blocks():
        shared = df.sparkSession.sparkContext.broadcast(block)  # block_weights at most, freed after the pass

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, first = shared.value, low
            known = held.features > held.features.min(axis=0) + 1e-6
            for batch in batches:
                out = []
                for feature, count in zip(batch["features"], batch["counts"]):
                    n = count.sum()
                    sums = held.prior + count @ held.features[feature].astype(np.float64)
                    means = sums / (n + PSEUDO)
                    at = int(sums.argmax())
                    out.append((first + at, sums[at], means[at], np.exp(means).sum(), count @ known[feature, at] / max(n, 1)))
                yield pd.DataFrame(out, columns=["number", "total", "mean", "odds", "shown"]).assign(uid=batch["uid"].to_numpy())

        found = table.mapInPandas(best, "number long, total double, mean double, odds double, shown double, uid long")
        parts.append(materialize(found, "label-block"))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, parts)
    first = F.max_by(F.struct("number", "mean", "shown"), F.struct("total", -F.col("number")))
    merged = every.groupBy("uid").agg(first.alias("best"), F.sum("odds").alias("odds"))
    names = df.sparkSession.createDataFrame(list(enumerate(model.labels)), "number long, _label string")
    score = F.exp("best.mean") / F.col("odds") * F.col("best.shown")
    merged = merged.select(F.col("uid").alias(uid), score.alias("_score"), F.col("best.number").alias("number")).join(names, "number")
    return rows.join(merged, uid).select(*df.columns, "_score", "_label")


def predict(model: CharacterModel | LabelTable, df: DataFrame, text_field: str = "text") -> DataFrame:
    """Add ``_score`` and ``_label`` of the likeliest label."""
    if isinstance(model, LabelTable):
        return _predict_by_blocks(model, df, text_field)
    shared = df.sparkSession.sparkContext.broadcast(model)  # labels times features, fixed when it was trained

    @F.pandas_udf("score double, label string")
    def likeliest(texts: pd.Series) -> pd.DataFrame:
        best = shared.value.best(texts.tolist())
        return pd.DataFrame({"score": best[0], "label": best[1]})

    best = df.withColumn("_best", likeliest.asNondeterministic()(F.coalesce(F.col(text_field), F.lit(""))))
    return best.select(*df.columns, F.col("_best.score").alias("_score"), F.col("_best.label").alias("_label"))


def train_character_model(
    df: DataFrame, text_field: str, label_field: str, ns: Sequence[int], features: int, block_weights: int = BLOCK_WEIGHTS
) -> CharacterModel | LabelTable:
    """Count features per label in every task, then sum the counts: one pass, whatever the share or number of the labels.

    Labels times features up to ``block_weights`` give a model in memory, more a table that is applied in blocks.
    """
    ns = tuple(ns)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for label, held in totals.items():
                used = np.flatnonzero(held)
                yield pd.DataFrame({"label": label, "feature": used, "n": held[used]})
            totals.clear()

        for batch in batches:
            for label, part in batch.groupby("label"):
                if label not in totals and len(totals) >= _HELD_LABELS:
                    yield from flushed()
                held = totals.setdefault(label, np.zeros(features + 1, np.int64))
                held[features] += len(part)  # the last place counts the texts
                for run in runs(part["text"].tolist()):
                    for _, gram in grams(run, ns, features):
                        held[:features] += np.bincount(gram, minlength=features)
        yield from flushed()

    labelled = df.select(F.col(label_field).cast("string").alias("label"), F.col(text_field).alias("text")).dropna()
    counts = labelled.mapInPandas(count, "label string, feature bigint, n bigint")
    summed = materialize(counts.groupBy("label", "feature").agg(F.sum("n").alias("n")), "model")
    is_text = F.col("feature") == features
    about = summed.groupBy("label").agg(F.sum(F.when(is_text, F.col("n"))).alias("texts"), F.sum(F.when(~is_text, F.col("n")).otherwise(0)).alias("total"))
    rows = sorted(about.collect(), key=lambda r: r["label"])  # a row per label
    if not rows:
        raise ValueError("no labelled text")
    labels = [r["label"] for r in rows]
    numbers = df.sparkSession.createDataFrame(list(enumerate(labels)), "number long, label string")
    numbered = materialize(summed.filter(~is_text).join(numbers, "label").select("number", "feature", "n"), "model-counts")
    table = LabelTable(
        numbered, labels, np.array([r["texts"] for r in rows], float), np.array([r["total"] for r in rows], float), features, ns, max(block_weights, features)
    )
    return next(table.blocks())[1] if len(labels) * features <= table.block_weights else table


def train_language_model(
    df: DataFrame, text_field: str = "text", label_field: str = "lang", ns: Sequence[int] = (1, 2, 3), features: int = 1 << 16, **settings
) -> CharacterModel | LabelTable:
    return train_character_model(df, text_field, label_field, ns, features, **settings)


def identify_language(
    df: DataFrame, model: CharacterModel | LabelTable, text_field: str = "text", score_field: str = "language", min_score: float = 0.0
) -> DataFrame:
    """Add ``language`` as a struct of score and upper-case code, and drop rows under the least score."""
    scored = predict(model, df, text_field)
    pair = F.struct(F.col("_score").alias("score"), F.upper("_label").alias("lang"))
    return scored.filter(F.col("_score") >= min_score).select(*df.columns, pair.alias(score_field))


def language_code(field: str = "language") -> Column:
    """The code alone, out of the score struct."""
    return F.col(field)["lang"]


def train_domain_model(
    df: DataFrame, text_field: str = "text", label_field: str = "domain", ns: Sequence[int] = (4, 6), features: int = 1 << 16
) -> CharacterModel | LabelTable:
    """Labels must be known domains."""
    known = F.when(F.col(label_field).isin(DOMAINS), F.col(label_field)).otherwise(
        F.raise_error(F.concat(F.lit("unknown domain "), F.col(label_field)))
    )
    return train_character_model(df.withColumn(label_field, known), text_field, label_field, ns, features)


def classify_domain(
    df: DataFrame, model: CharacterModel | LabelTable | Callable[[DataFrame], DataFrame], text_field: str = "text", pred_field: str = "domain_pred"
) -> DataFrame:
    """Add the domain of every document; nothing is dropped.  ``model`` may be any function that adds the column."""
    if not isinstance(model, (CharacterModel, LabelTable)):
        return model(df)
    return predict(model, df, text_field).withColumnRenamed("_label", pred_field).drop("_score")


def quality_training_set(
    high: DataFrame, low: DataFrame, num_samples: int, key: str, text_field: str = "text", seed: int = 42
) -> DataFrame:
    """Labelled one-line samples, about ``num_samples`` per class: ``(key, text)``.

    The order is not mixed, as training passes do not depend on it; ``sampling.shuffle`` does it for a file to hand on.
    """
    parts = []
    for df, label in ((low, "__label__lq"), (high, "__label__hq")):
        sampled = sample_about(df.select(key, text_field), num_samples, key, seed)
        parts.append(sampled.withColumn(text_field, label_prefix(label)(F.col(text_field))))
    return parts[0].unionByName(parts[1])


def read_training_lines(df: DataFrame, field: str = "value") -> DataFrame:
    """``(label, text)`` from labelled lines."""
    pieces = F.split(field, " ", 2)
    label = F.regexp_replace(F.element_at(pieces, 1), "^__label__", "")
    return df.select(label.alias("label"), F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit("")).alias("text"))


def train_quality_model(
    df: DataFrame, text_field: str = "text", label_field: str = "label", lr: float = 0.01, dim: int = 100, epoch: int = 5, word_ngrams: int = 2, **settings
) -> TextModel:
    """The supervised classifier over a labelled sample; see ``train_supervised``."""
    return train_supervised(df, text_field, label_field, lr, dim, epoch, word_ngrams, **settings)


def score_quality(df: DataFrame, model: TextModel, high_label: str = "hq", text_field: str = "text") -> DataFrame:
    """Add ``quality_score``, the probability of the high-quality label."""
    return model.predict(df, high_label, text_field, "quality_score")


def keep_by_quality(
    scored: DataFrame, key: str, alpha: float | None = 9.0, threshold: float | None = None, seed: int = 42,
    score_field: str = "quality_score",
) -> DataFrame:
    """Keep by threshold, or as Brown et al. 2020 do: if a Pareto(alpha) draw exceeds one minus the score.

    The draw is fixed by seed and key, so a rerun keeps the same documents.
    """
    if threshold is not None:
        return scored.filter(F.col(score_field) >= threshold)
    uniform = F.lit(1.0) - hash_unit(seed, key)  # in (0, 1]
    draw = F.pow(uniform, F.lit(-1.0 / alpha)) - 1.0
    return scored.filter(draw > 1.0 - F.col(score_field))
