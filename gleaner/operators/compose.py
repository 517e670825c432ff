"""Steps and their composition: modify, score-and-filter, sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Sequential:
    """Run steps one after another.  A step is any function from DataFrame to DataFrame, also another sequence."""

    def __init__(self, steps: Iterable[Step]):
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, step: d.transform(step), self.steps, df)


class Modify:
    """Rewrite the text column with a column function (native expression or Arrow UDF)."""

    def __init__(self, modifier: Callable[[Column], Column], text_field: str = "text"):
        self.modifier, self.text_field = modifier, text_field

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.text_field, self.modifier(F.col(self.text_field)))


def python_modifier(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A user's ``text -> text`` function as a modifier, run on Arrow batches; nulls stay null."""

    def modifier(text: Column) -> Column:
        @F.pandas_udf("string")
        def modified(texts: pd.Series) -> pd.Series:
            return texts.map(function, na_action="ignore")

        return modified.asNondeterministic()(text)

    return modifier


class ScoreFilter:
    """Score the text, keep the rows whose score passes, and keep the score column only if it is named."""

    def __init__(self, filt, text_field: str = "text", score_field: str | None = None, score_type: str | None = None):
        self.filter, self.text_field = filt, text_field
        self.score_field, self.score_type = score_field, score_type

    def __call__(self, df: DataFrame) -> DataFrame:
        from gleaner.operators.filters import with_features

        out, text = with_features(df, self.text_field, [self.filter])
        score = self.filter.score(text)
        if self.score_type:
            score = score.cast(self.score_type)
        name = self.score_field or "_score"
        out = out.withColumn(name, score).filter(F.coalesce(self.filter.keep(F.col(name)), F.lit(False)))
        return out.select(*[c for c in df.columns if c != name], *([name] if self.score_field else []))


def skip_if_exists(path: str, build: Callable[[], DataFrame], spark) -> DataFrame:
    """Use the stage output at ``path`` when an earlier run finished it, else build and write it."""
    from gleaner.sources.readers import exists

    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
