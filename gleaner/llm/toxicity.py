"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over hashed words and word beginnings is fitted on labelled texts.  Each labelled text that names a
group (an identity term) has two counterfactual twins: one with every such term swapped for another one of its kind, one
with it left out.  The fit penalises the square of the difference between its score and theirs, so that the mere mention
of a group does not move the score, and a term that is frequent in the toxic part of the labels is no sign of toxicity.

The fit uses at most ``max_rows`` labelled rows, those with the smallest hash of the id; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textmodel import Features, Model, labelled_sample, train
from gleaner.llm.words import parts

#: Groups of terms that may stand for each other.
IDENTITY_TERMS: Mapping[str, Sequence[str]] = {
    "en faith": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    "en faiths": ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    "en origin": ("black", "white", "asian", "african", "latino", "european", "arab"),
    "en gender": ("woman", "man"),
    "en genders": ("women", "men"),
    "en orientation": ("gay", "straight", "lesbian", "bisexual", "transgender"),
    "en ability": ("deaf", "blind", "disabled"),
    "de": ("christen", "muslime", "juden", "hindus", "schwarze", "frauen", "schwule", "lesben", "behinderte"),
    "fr": ("chrétiens", "musulmans", "juifs", "noirs", "arabes", "femmes", "homosexuels", "lesbiennes"),
    "es": ("cristianos", "musulmanes", "judíos", "negros", "árabes", "mujeres", "homosexuales", "lesbianas"),
}

FEATURES = Features(letters_only=True, chars=(3, 4, 5, 6, 7), prefixes=True, words=(1,), bits=18)
MAX_ROWS = 8_000
THRESHOLD = 0.3


def twins(groups: Mapping[str, Sequence[str]] = IDENTITY_TERMS) -> tuple[Callable[[str], str], ...]:
    """The functions that give a text its counterfactual twins: each term the next of its group, or left out."""
    following = {term: terms[(i + 1) % len(terms)] for terms in groups.values() for i, term in enumerate(terms)}
    if not following:
        return ()
    pattern = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(sorted(map(re.escape, following), key=len, reverse=True)), re.IGNORECASE)
    return (lambda text: pattern.sub(lambda m: following[m[0].lower()], text), lambda text: pattern.sub("", text))


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    groups: Mapping[str, Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 1.0,
    l2: float = 1e-5,
    features: Features = FEATURES,
) -> Model:
    """Fit on ``docs`` (``doc_id``, ``text``) that ``labels`` marks with 0 or 1; null labels, ids and texts teach nothing."""
    sample = labelled_sample(docs.filter("text IS NOT NULL"), labels, label, max_rows)
    return train(sample, features, l2, twins(groups), penalty)


def score_text(model: Model, spark) -> Callable[[str], Column]:
    """A column function: the probability of the label for each whole text; null and empty texts get the model's base rate."""
    shared = spark.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        chunks = [pa.array(shared.value.score(part.column("text")), pa.float64()) for part in parts(pa.record_batch([column], ["text"]), limit=1 << 20)]
        return pa.concat_arrays(chunks) if chunks else pa.array([], pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more); every row stays, columns of those names are replaced."""
    scored = docs.withColumn(score, score_text(model, docs.sparkSession)("text"))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
