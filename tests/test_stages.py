from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gleaner.plans.stages import Stage, run_stages


def names(folder):
    return {n.rsplit("-", 1)[0] for n in os.listdir(folder) if not n.startswith(("_", "."))}


def plan(ran, fail=None, version="", seen=None):
    """a -> b, and both -> c."""

    def step(name, fn):
        def build(*tables):
            ran.append(name)
            if seen is not None:
                seen.append(names(seen[0]) if os.path.isdir(seen[0]) else set())
            if name == fail:
                raise RuntimeError("killed")
            return fn(*tables)

        return build

    return [
        Stage("a", step("a", lambda d: d.filter("id < 50")), ("numbers",)),
        Stage("b", step("b", lambda a: a.filter("id % 2 = 0")), ("a",), version),
        Stage("c", step("c", lambda a, b: a.join(b, "id").agg(F.count("*").alias("n"))), ("a", "b")),
        Stage("d", step("d", lambda c: c.withColumn("n", F.col("n") + 1)), ("c",)),
    ]


def test_killed_run_resumes_and_tables_are_freed(spark, tmp_path):
    folder, sources = f"{tmp_path}/plan", {"numbers": spark.range(100)}
    ran = []
    with pytest.raises(RuntimeError):
        run_stages(spark, sources, plan(ran, fail="c"), folder)
    assert ran == ["a", "b", "c"] and names(folder) == {"a", "b"}
    ran.clear()
    assert run_stages(spark, sources, plan(ran), folder).first().n == 26
    assert ran == ["c", "d"] and names(folder) == {"d"}
    ran.clear()
    assert run_stages(spark, sources, plan(ran), folder).first().n == 26
    assert ran == []


def test_tables_go_after_their_last_reader(spark, tmp_path):
    seen = [f"{tmp_path}/plan"]
    run_stages(spark, {"numbers": spark.range(100)}, plan([], seen=seen), seen[0])
    assert seen[1:] == [set(), {"a"}, {"a", "b"}, {"c"}]


def test_half_written_table_is_written_again(spark, tmp_path):
    folder, sources = f"{tmp_path}/plan", {"numbers": spark.range(100)}
    with pytest.raises(RuntimeError):
        run_stages(spark, sources, plan([], fail="c"), folder)
    for name in os.listdir(f"{folder}/_marks"):
        if name.startswith("b-"):
            os.remove(f"{folder}/_marks/{name}")
    ran = []
    assert run_stages(spark, sources, plan(ran), folder).first().n == 26
    assert ran == ["b", "c", "d"]


def test_new_version_runs_again_with_what_it_needs(spark, tmp_path):
    folder, sources = f"{tmp_path}/plan", {"numbers": spark.range(100)}
    run_stages(spark, sources, plan([]), folder)
    ran = []
    assert run_stages(spark, sources, plan(ran, version="2"), folder).first().n == 26
    assert ran == ["a", "b", "c", "d"]  # the table of a is gone, so it is made again


def test_kept_tables_stay_and_empty_tables_pass(spark, tmp_path):
    folder = f"{tmp_path}/plan"
    out = run_stages(spark, {"numbers": spark.range(0)}, plan([]), folder, keep=["a"])
    assert out.first().n == 1 and names(folder) == {"a", "d"}
    ran = []
    run_stages(spark, {"numbers": spark.range(0)}, plan(ran, version="2"), folder, keep=["a"])
    assert ran == ["b", "c", "d"]


def test_wrong_plans_are_refused(spark, tmp_path):
    same = Stage("a", lambda d: d, ("numbers",))
    for stages in ([], [same, same], [Stage("a", lambda d: d, ("later",))]):
        with pytest.raises(ValueError):
            run_stages(spark, {"numbers": spark.range(1)}, stages, f"{tmp_path}/plan")
