"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step takes the smallest neighbour per node, a grouping that combines on the map side, and joins it back
to the edges.  The centre of a star may hold a third of all edges, so that join spreads heavy nodes.  The edges
after each step are a written table: lineage stays short and a lost executor costs one step.  The table of the step
before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import join_by_heavy_key
from gleaner.session import discard, materialize, scratch_path


def _large_star(edges: DataFrame, rows_per_salt: int | None) -> DataFrame:
    """Move each edge from its low end to that end's own smallest neighbour."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "lo")
    weights = edges.groupBy("lo").agg(F.count("*").alias("n"))
    joined = join_by_heavy_key(edges, least, "lo", weights, "left", rows_per_salt)
    return joined.select("hi", F.coalesce("least", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, rows_per_salt: int | None) -> DataFrame:
    """Join a node and its low neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("n"))
    joined = join_by_heavy_key(edges, least, "hi", least, "inner", rows_per_salt)
    moved = joined.filter(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    kept = least.select("hi", F.col("least").alias("lo"))
    return moved.unionByName(kept).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one low end, and no low end has one itself."""
    if not edges.groupBy("hi").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    centres = edges.select("lo").distinct()
    return centres.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", id_field: str = "id", rows_per_salt: int | None = None
) -> DataFrame:
    """``(id, group)`` for every node of an edge, ``group`` being the smallest id of its component."""
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    current = edges.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    path = scratch_path(spark, "edges")
    current = materialize(current, "edges", path)
    while not _settled(current):  # the number of rounds grows with the logarithm of the nodes
        for step, name in ((_large_star, "large-star"), (_small_star, "small-star")):
            previous, path = path, scratch_path(spark, name)
            current = materialize(step(current, rows_per_salt), name, path)
            discard(spark, previous)
    members = current.select(F.col("hi").alias(id_field), F.col("lo").alias("group"))
    centres = current.select("lo").distinct().select(F.col("lo").alias(id_field), F.col("lo").alias("group"))
    return members.unionByName(centres)
