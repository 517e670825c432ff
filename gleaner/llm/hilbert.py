"""Shards cut from a Hilbert curve over several metadata dimensions; DataFrame functions only.

Each dimension is quantised to 2^bits steps: a number by its quantiles, a text by its hash, so that equal values share a
step.  Documents are sorted by their place on the curve through the grid of steps and cut into runs of equal counts.
Neighbours on the curve are neighbours in every dimension, so a filter on any of them touches few shards, and the
minimum and maximum per shard prune files.

Ranks need no global window: the narrow rows are range partitioned by (curve place, hash of the text, id) and written in
that order; the offsets of the partitions are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import unused
from gleaner.session import materialize


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with whole coordinates from 0 to 2^bits - 1 (Skilling 2004).

    One fold over (bit, dimension) undoes the rotations, one over dimensions makes the Gray code, one weaves the bits.
    """
    n = len(coordinates)
    if not 0 < n * bits < 63:
        raise ValueError("dimensions times bits must be from 1 to 62")
    point = F.array(*(c.cast("long") for c in coordinates))

    def q_of(step: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits - 1) - F.floor(step / n).cast("int"))

    def unturn(x: Column, step: Column) -> Column:
        q, i = q_of(step), (step % n).cast("int")
        low = q - 1
        here, first = F.get(x, i), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        flip = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when(flip & (j == 0), v.bitwiseXOR(low)).when(~flip & (i != 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v),
        )

    steps = F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)) if bits > 1 else F.array().cast("array<int>")
    turned = F.aggregate(steps, point, unturn)
    zero = F.array().cast("array<bigint>")
    gray = F.aggregate(turned, zero, lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))))))

    def weave(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        # Exclusive or of q - 1 over the set bits q > 1 of the last coordinate.
        parity = F.aggregate(
            F.sequence(F.lit(1), F.lit(bits)),
            F.lit(0).cast("long"),
            lambda t, b: F.when(F.getbit(last, b - 1) == 1, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - 1) - 1)).otherwise(t),
        )
        digits = F.sequence(F.lit(0), F.lit(n * bits - 1))

        def digit(total: Column, k: Column) -> Column:
            bit = F.getbit(F.get(x, (k % n).cast("int")).bitwiseXOR(parity), F.lit(bits - 1) - F.floor(k / n).cast("int"))
            return total * 2 + bit

        return F.aggregate(digits, F.lit(0).cast("long"), digit)

    return F.get(F.transform(F.array(gray), weave), F.lit(0))


def quantile_step(df: DataFrame, column: str, bits: int) -> Column:
    """The number of the 2^bits - 1 quantiles that lie at or below a value; a null is step 0."""
    probabilities = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(F.percentile_approx(column, probabilities, 10_000).alias("cuts")).first()["cuts"] or []  # 2^bits numbers
    value = F.coalesce(F.col(column), F.lit(min(cuts, default=0)).cast("double") - 1)
    found = F.lit(0)
    for cut in sorted(set(cuts)):
        found = found + (value >= F.lit(cut)).cast("int")
    return found


def hash_step(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def hilbert_shards(docs: DataFrame, numbers: Sequence[str], texts: Sequence[str], shards: int, tie: Sequence[str], bits: int = 4) -> DataFrame:
    """``docs`` with ``curve``, ``shard`` and ``slot``: runs of the curve whose counts differ by at most one.

    ``numbers`` and ``texts`` are the dimensions, ``tie`` orders documents of one grid cell.  Nulls have a step of their own
    kind (a number's lowest, the hash of null).  Repeated rows take places of their own; no row is dropped.  Rows are
    written once to the shared folder, so give the columns you need and not the text.  Columns of ``docs`` named ``curve``,
    ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = materialize(docs.drop("curve", "shard", "slot"), "hilbert-input")
    place, part, rows, before, total, rank = unused(docs, "place", "part", "rows", "before", "total", "rank", also=["curve", "shard", "slot"])
    steps = [quantile_step(docs, c, bits) for c in numbers] + [hash_step(c, bits) for c in texts]
    order = ["curve", *tie]
    ranged = docs.withColumn("curve", hilbert_index(steps, bits)).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn(place, F.monotonically_increasing_id()), "hilbert-ranged")
    ranged = ranged.withColumn(part, F.shiftright(place, 33))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(rows))  # one row per partition
    ahead = F.coalesce(F.sum(rows).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(part, ahead.alias(before), F.sum(rows).over(Window.partitionBy()).alias(total))
    ranked = ranged.join(F.broadcast(offsets), part).withColumn(rank, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before))
    ranked = ranked.withColumn("shard", F.expr(f"CAST(({rank} * {shards}) div {total} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards} - 1) div {shards}")
    return ranked.withColumn("slot", F.col(rank) - first).drop(place, part, before, total, rank)


def shard_bounds(sharded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and the smallest and largest value of each column per shard, for pruning."""
    ranges = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ranges)
