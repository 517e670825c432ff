"""A plan in written stages that a killed run resumes, and that frees a table after its last reader.

Each stage writes a parquet table in the plan's folder and then a mark, an empty file.  A mark's name holds a digest of the
stage's version and of those of all stages before it, so that a changed stage and what follows it run again and the
others do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import discard, exists, materialize, touch


@dataclass(frozen=True)
class Stage:
    """``build`` takes the tables that ``reads`` names, in that order: sources of the plan or earlier stages.

    Change ``version`` when ``build`` or a source changes; functions and rows are not compared.
    """

    name: str
    build: Callable[..., DataFrame]
    reads: tuple[str, ...]
    version: str = ""


def _digests(stages: Sequence[Stage], sources: set[str]) -> dict[str, str]:
    known = {name: name for name in sources}
    for stage in stages:
        missing = [name for name in stage.reads if name not in known]
        if missing:
            raise ValueError(f"{stage.name} reads {missing}, which no earlier stage writes")
        if stage.name in known:
            raise ValueError(f"two tables are named {stage.name}")
        parts = [stage.name, stage.version, *[known[name] for name in stage.reads]]
        known[stage.name] = hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]
    return known


def run_stages(
    spark: SparkSession, sources: dict[str, DataFrame], stages: Sequence[Stage], folder: str, keep: Sequence[str] = ()
) -> DataFrame:
    """The table of the last stage.  ``folder`` must be one that all executors see; one plan at a time may use it.

    A stage with a mark is not run again.  One without, even if its table is half written, is, and so are stages before it
    whose tables it needs and that are gone.  A table is deleted when every stage that reads it has its mark; the last
    one's and those in ``keep`` stay.
    """
    if not stages:
        raise ValueError("a plan needs a stage")
    digests = _digests(stages, set(sources))
    path = {s.name: f"{folder}/{s.name}-{digests[s.name]}" for s in stages}
    mark = {s.name: f"{folder}/_marks/{s.name}-{digests[s.name]}" for s in stages}
    readers = {s.name: [r.name for r in stages if s.name in r.reads] for s in stages}
    kept = {stages[-1].name, *keep}
    done = {s.name for s in stages if exists(spark, mark[s.name])}
    stored = {s.name for s in stages if s.name in done and exists(spark, path[s.name])}
    # Backwards: what a stage that must run reads has to be there, as has what the caller gets.
    to_run: set[str] = set()
    for stage in reversed(stages):
        wanted = stage.name in kept or any(r in to_run for r in readers[stage.name])
        if stage.name not in done or (wanted and stage.name not in stored):
            to_run.add(stage.name)
    tables = dict(sources) | {name: spark.read.parquet(path[name]) for name in stored - to_run}
    left = {name: {r for r in readers[name] if r in to_run} for name in path}

    def free() -> None:
        for name in [n for n in tables if n in path and n not in kept and not left[n]]:
            discard(spark, path[name])
            del tables[name]

    free()  # a run may have been killed between a mark and its deletions
    for stage in stages:
        if stage.name in to_run:
            built = stage.build(*[tables[name] for name in stage.reads])
            tables[stage.name] = materialize(built, stage.name, path[stage.name])
            touch(spark, mark[stage.name])
            for name in stage.reads:
                if name in left:
                    left[name].discard(stage.name)
            free()
    return tables[stages[-1].name]
