"""Names for helper columns that cannot clash with the columns of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str, also: Iterable[str] = ()) -> list[str]:
    """The names, each lengthened until no column of ``df`` (case ignored) bears it."""
    taken = {c.lower() for c in (*df.columns, *also)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
