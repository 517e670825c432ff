"""Document quality heuristics and their cascade.

A filter gives a score column and a rule on the score.  The word, line and paragraph splits are computed
once per document however many filters use them, native filters run before the one Python pass that yields
every n-gram score, and a whole cascade stays in one stage without a shuffle.

Ratios are null for a text without words or lines; such a text is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import ngrams
from gleaner.functions.text import (
    FULL_STOPS,
    SPACES,
    compute_once,
    line_ends,
    lines,
    matched_chars,
    occurrences,
    paragraphs,
    sentences,
    strip,
    total_length,
    words,
)

# Sentence ends, bullet marks, URL form and boilerplate phrases (the phrases are those of
# Raffel et al. 2020, section 2.2).
TERMINATORS = [".", "!", "?", '"', "”"]
BULLETS = ["•", "‣", "◦", "▪", "●", "–", "-", "*"]
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
BOILERPLATE = [
    "terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies",
    "lorem ipsum",
]


@dataclass(frozen=True)
class Text:
    """The text of a document and what the filters derive from it."""

    text: Column
    words: Column
    lines: Column
    line_ends: Column
    sentence_ends: Column
    paragraphs: Column
    lower: Column
    word_chars: Column
    repetition: Column

    @property
    def chars(self) -> Column:
        return F.length(self.text)


@dataclass(frozen=True)
class TextFilter:
    """``score`` maps a Text to a column, ``keep`` a score to a boolean column.

    ``uses`` names the derived arrays the score reads; ``top_ns`` and ``dup_ns`` the n-gram lengths.
    """

    name: str
    score: Callable[[Text], Column]
    keep: Callable[[Column], Column]
    uses: frozenset[str] = field(default_factory=frozenset)
    top_ns: tuple[int, ...] = ()
    dup_ns: tuple[int, ...] = ()
    python: bool = False  # the score runs in Python, so it comes after the native filters

    @property
    def native(self) -> bool:
        return not (self.top_ns or self.dup_ns or self.python)


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _at_most(limit: float) -> Callable[[Column], Column]:
    return lambda score: score <= F.lit(float(limit))


def _at_least(limit: float) -> Callable[[Column], Column]:
    return lambda score: score >= F.lit(float(limit))


def _uses(*names: str) -> frozenset[str]:
    return frozenset(names)


def word_count(min_words: int = 50, max_words: int = 100_000, lang: str = "en") -> TextFilter:
    """Number of words within bounds.  Words are parted by white space, so ``lang`` must be a language that does so."""
    if lang.lower()[:2] in ("zh", "ja", "th", "lo", "km", "my"):
        raise ValueError(f"words of {lang} are not parted by white space")
    return TextFilter(
        "word_count", lambda t: F.size(t.words), lambda s: s.between(min_words, max_words), _uses("words")
    )


def complete_document() -> TextFilter:
    """The stripped text ends with a sentence end; an empty text does not."""
    return TextFilter(
        "complete_document",
        lambda t: F.coalesce(F.right(strip(t.text), F.lit(1)).isin(TERMINATORS), F.lit(False)),
        lambda s: s,
    )


def symbols_to_words(max_symbol_to_word_ratio: float = 0.1) -> TextFilter:
    """Hash signs and ellipses per word."""

    def score(t: Text) -> Column:
        marks = [occurrences(t.text, mark) for mark in ("#", "...", "…")]
        return _ratio(marks[0] + marks[1] + marks[2], F.size(t.words))

    return TextFilter("symbols_to_words", score, _at_most(max_symbol_to_word_ratio), _uses("words"))


def numbers(max_number_to_text_ratio: float = 0.15) -> TextFilter:
    """Decimal digits of any script over characters."""
    return TextFilter(
        "numbers",
        lambda t: _ratio(F.length(F.regexp_replace(t.text, r"\P{Nd}+", "")), t.chars),
        _at_most(max_number_to_text_ratio),
    )


def urls(max_url_to_text_ratio: float = 0.2) -> TextFilter:
    """Characters in URLs over characters."""

    def score(t: Text) -> Column:
        possible = t.text.contains("http") | t.text.contains("www.")
        return _ratio(F.when(possible, matched_chars(t.text, URL)).otherwise(0), t.chars)

    return TextFilter("urls", score, _at_most(max_url_to_text_ratio))


def white_space(max_white_space_ratio: float = 0.25) -> TextFilter:
    """White space, which is all that is in no word, over characters."""
    return TextFilter(
        "white_space",
        lambda t: _ratio(t.chars - t.word_chars, t.chars),
        _at_most(max_white_space_ratio),
        _uses("words", "word_chars"),
    )


def parentheses(max_parentheses_ratio: float = 0.1) -> TextFilter:
    """Brackets of the three kinds over characters."""
    return TextFilter(
        "parentheses",
        lambda t: _ratio(F.length(F.regexp_replace(t.text, r"[^()\[\]{}]+", "")), t.chars),
        _at_most(max_parentheses_ratio),
    )


def boilerplate(
    remove_if_at_top_or_bottom: bool = True,
    max_boilerplate_string_ratio: float = 0.4,
    phrases: Sequence[str] = tuple(BOILERPLATE),
) -> TextFilter:
    """Share of paragraphs holding a boilerplate phrase; 1 when the first or last paragraph does."""

    def holds(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])

    def score(t: Text) -> Column:
        share = _ratio(F.size(F.filter(t.paragraphs, lambda p: holds(F.lower(p)))), F.size(t.paragraphs))
        if remove_if_at_top_or_bottom:
            first = holds(F.lower(F.try_element_at(t.paragraphs, F.lit(1))))
            last = holds(F.lower(F.try_element_at(t.paragraphs, F.lit(-1))))
            share = F.when(first | last, F.lit(1.0)).otherwise(share)
        # Most texts hold no phrase at all, and their paragraphs need no second look.
        return F.when(F.size(t.paragraphs) > 0, F.when(holds(t.lower), share).otherwise(F.lit(0.0)))

    return TextFilter("boilerplate", score, _at_most(max_boilerplate_string_ratio), _uses("paragraphs", "lower"))


def _unique_share(name: str, unit: str, by_char: bool, minimum: float) -> TextFilter:
    def score(t: Text) -> Column:
        pieces = getattr(t, unit)
        size = total_length if by_char else F.size
        return _ratio(size(F.array_distinct(pieces)), size(pieces))

    return TextFilter(name, score, _at_least(minimum), _uses(unit))


# The configured limits of these four are lower bounds on the unique share: they are the complements of the
# published limits on the repeated share (0.3, 0.3, 0.2, 0.2).
def unique_lines(min_unique_fraction: float = 0.7) -> TextFilter:
    return _unique_share("unique_lines", "lines", False, min_unique_fraction)


def unique_paragraphs(min_unique_fraction: float = 0.7) -> TextFilter:
    return _unique_share("unique_paragraphs", "paragraphs", False, min_unique_fraction)


def unique_line_chars(min_unique_fraction: float = 0.8) -> TextFilter:
    return _unique_share("unique_line_chars", "lines", True, min_unique_fraction)


def unique_paragraph_chars(min_unique_fraction: float = 0.8) -> TextFilter:
    return _unique_share("unique_paragraph_chars", "paragraphs", True, min_unique_fraction)


def _line_share(name: str, unit: str, rule: Callable[[Column], Column], limit: float) -> TextFilter:
    def score(t: Text) -> Column:
        pieces = getattr(t, unit)
        return _ratio(F.size(F.filter(pieces, rule)), F.size(pieces))

    return TextFilter(name, score, _at_most(limit), _uses(unit))


def punctuation(max_num_sentences_without_endmark_ratio: float = 0.85) -> TextFilter:
    """Sentences that do not end with a sentence end, the danda and wide marks among them, over sentences."""
    open_end = lambda end: ~end.isin([*TERMINATORS, *FULL_STOPS])
    return _line_share("punctuation", "sentence_ends", open_end, max_num_sentences_without_endmark_ratio)


def mean_word_length(min_mean_word_length: float = 3, max_mean_word_length: float = 10) -> TextFilter:
    return TextFilter(
        "mean_word_length",
        lambda t: _ratio(t.word_chars, F.size(t.words)),
        lambda s: s.between(float(min_mean_word_length), float(max_mean_word_length)),
        _uses("words", "word_chars"),
    )


def long_word(max_word_length: int = 1000) -> TextFilter:
    return TextFilter(
        "long_word",
        lambda t: F.array_max(F.transform(t.words, F.length)),
        lambda s: s <= max_word_length,
        _uses("words"),
    )


def ellipsis(max_num_lines_ending_with_ellipsis_ratio: float = 0.3) -> TextFilter:
    trails = lambda end: end.endswith("...") | end.endswith("…")
    return _line_share("ellipsis", "line_ends", trails, max_num_lines_ending_with_ellipsis_ratio)


def top_ngram(n: int, max_repeating_ngram_ratio: float) -> TextFilter:
    """Share of the text taken by its most frequent n-gram."""
    return TextFilter(
        f"top_{n}gram",
        lambda t: t.repetition[ngrams.top_field(n)],
        _at_most(max_repeating_ngram_ratio),
        top_ns=(n,),
    )


def duplicate_ngram(n: int, max_repeating_duplicate_ngram_ratio: float) -> TextFilter:
    """Share of the text lying in repeated n-grams."""
    return TextFilter(
        f"duplicate_{n}gram",
        lambda t: t.repetition[ngrams.dup_field(n)],
        _at_most(max_repeating_duplicate_ngram_ratio),
        dup_ns=(n,),
    )


def bullets(max_bullet_lines_ratio: float = 0.9) -> TextFilter:
    marked = lambda line: F.left(F.ltrim(line, F.lit(SPACES)), F.lit(1)).isin(BULLETS)
    return _line_share("bullets", "lines", marked, max_bullet_lines_ratio)


def custom_filter(name: str, score: Callable[[Column], Column], keep: Callable[[Column], Column]) -> TextFilter:
    """A user's own filter over the text column."""
    return TextFilter(name, lambda t: score(t.text), keep)


def python_filter(
    name: str, score: Callable[[str], Any], keep: Callable[[Column], Column], score_type: str = "double"
) -> TextFilter:
    """A user's ``text -> score`` function, run on Arrow batches, with a rule on the score column."""

    def scored(text: Column) -> Column:
        @F.pandas_udf(score_type)
        def scores(texts: pd.Series) -> pd.Series:
            return texts.map(score, na_action="ignore")

        return scores.asNondeterministic()(text)

    return TextFilter(name, lambda t: scored(t.text), keep, python=True)


_DERIVED = {
    "words": words, "lines": lines, "line_ends": line_ends, "paragraphs": paragraphs, "lower": F.lower,
    "sentence_ends": lambda text: F.transform(sentences(text), lambda s: F.right(s, F.lit(1))),
}


def with_features(df: DataFrame, text_field: str, filters: Iterable[TextFilter]) -> tuple[DataFrame, Text]:
    """Add the arrays and n-gram scores the filters read, each computed once per row."""
    filters = list(filters)
    text = F.col(text_field)
    uses = sorted(set().union(*[f.uses for f in filters]))
    derived = {f"_{u}": _DERIVED[u](text) for u in uses if u in _DERIVED}
    if derived:
        # The text goes through the generator too, else the optimizer moves a predicate on it, and with it
        # the n-gram pass, below the cheap native filters.
        out = compute_once(df, _text=text, **derived)
        text = F.col("_text")
        if "word_chars" in uses:
            out = compute_once(out, _word_chars=total_length(F.col("_words")))
    else:
        out = df
    top_ns = [n for f in filters for n in f.top_ns]
    dup_ns = [n for f in filters for n in f.dup_ns]
    if top_ns or dup_ns:
        out = out.withColumn("_repetition", ngrams.repetition(text, top_ns, dup_ns))
    return out, Text(text, **{f.name: F.col(f"_{f.name}") for f in fields(Text) if f.name != "text"})


class FilterCascade:
    """An ordered list of filters over one text column."""

    def __init__(self, filters: Sequence[TextFilter], text_field: str = "text"):
        self.filters, self.text_field = list(filters), text_field

    def _passes(self, filt: TextFilter, text: Text) -> Column:
        return F.coalesce(filt.keep(filt.score(text)), F.lit(False))

    def __call__(self, df: DataFrame) -> DataFrame:
        """Rows that pass every filter.  Native filters come first, so Python sees only their survivors."""
        out = df
        for group in (
            [f for f in self.filters if f.native],
            [f for f in self.filters if not f.native],
        ):
            if group:
                out, text = with_features(out, self.text_field, group)
                out = out.filter(reduce(lambda a, b: a & b, [self._passes(f, text) for f in group]))
                # The generator's copy of the text goes on, so that the n-gram pass stays above this filter.
                out = out.select(*[text.text.alias(c) if c == self.text_field else F.col(c) for c in df.columns])
        return out

    def scores(self, df: DataFrame) -> DataFrame:
        """All rows with one more column per filter, named after it."""
        out, text = with_features(df, self.text_field, self.filters)
        return out.select(*df.columns, *[f.score(text).alias(f.name) for f in self.filters])

    def dropped_by(self, df: DataFrame, field_name: str = "dropped_by") -> DataFrame:
        """All rows with the name of the first filter, in listed order, that drops them; null for kept rows."""
        out, text = with_features(df, self.text_field, self.filters)
        first = F.coalesce(*[F.when(~self._passes(f, text), F.lit(f.name)) for f in self.filters])
        return out.select(*df.columns, first.alias(field_name))

    def report(self, df: DataFrame) -> DataFrame:
        """Rows before and after each filter, from one pass over the data."""
        drops = self.dropped_by(df).groupBy("dropped_by").agg(F.count("*").alias("n"))
        gone = [F.coalesce(F.sum(F.when(F.col("dropped_by") == f.name, F.col("n"))), F.lit(0)) for f in self.filters]
        totals = drops.agg(F.sum("n").alias("_total"), *[g.alias(f"_gone_{i}") for i, g in enumerate(gone)])
        rows, before = [], F.coalesce(F.col("_total"), F.lit(0))
        for i, f in enumerate(self.filters):
            after = before - F.col(f"_gone_{i}")
            rows.append(
                F.struct(
                    F.lit(i + 1).alias("step"), F.lit(f.name).alias("filter"),
                    before.alias("rows_in"), after.alias("rows_out"),
                )
            )
            before = after
        return totals.select(F.inline(F.array(*rows)))


# The filter names of existing config files, which are the last part of a dotted class path, with the
# builder of each and the parameter names used there.
BUILDERS: dict[str, Callable[..., TextFilter]] = {
    "WordCountFilter": word_count,
    "IncompleteDocumentFilter": complete_document,
    "SymbolsToWordsFilter": symbols_to_words,
    "NumbersFilter": numbers,
    "UrlsFilter": urls,
    "WhiteSpaceFilter": white_space,
    "ParenthesesFilter": parentheses,
    "BoilerPlateStringFilter": boilerplate,
    "RepeatedLinesFilter": lambda max_repeated_line_fraction=0.7: unique_lines(max_repeated_line_fraction),
    "RepeatedParagraphsFilter": lambda max_repeated_paragraphs_ratio=0.7: unique_paragraphs(
        max_repeated_paragraphs_ratio
    ),
    "RepeatedLinesByCharFilter": lambda max_repeated_lines_char_ratio=0.8: unique_line_chars(
        max_repeated_lines_char_ratio
    ),
    "RepeatedParagraphsByCharFilter": lambda max_repeated_paragraphs_char_ratio=0.8: unique_paragraph_chars(
        max_repeated_paragraphs_char_ratio
    ),
    "PunctuationFilter": punctuation,
    "MeanWordLengthFilter": mean_word_length,
    "LongWordFilter": long_word,
    "EllipsisFilter": ellipsis,
    "RepeatingTopNGramsFilter": top_ngram,
    "RepeatingDuplicateNGramsFilter": duplicate_ngram,
    "BulletsFilter": bullets,
}


def cascade_from_config(config: dict[str, Any]) -> FilterCascade:
    """Build the cascade from ``{input_field, filters: [{name, params}]}``; order is kept.

    A name is a builder's own name (``word_count``) or a class path ending in a known filter class.
    """
    own = {f.__name__: f for f in BUILDERS.values() if f.__name__ != "<lambda>"}
    own |= {f.__name__: f for f in (unique_lines, unique_paragraphs, unique_line_chars, unique_paragraph_chars)}
    filters = []
    for entry in config["filters"]:
        name = entry["name"].rsplit(".", 1)[-1]
        build = BUILDERS.get(name) or own.get(name)
        if build is None:
            raise ValueError(f"unknown filter {entry['name']!r}")
        filters.append(build(**(entry.get("params") or {})))
    return FilterCascade(filters, config.get("input_field", "text"))


def build_filter_cascade(path: str) -> FilterCascade:
    """Read the cascade from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return cascade_from_config(yaml.safe_load(handle))
