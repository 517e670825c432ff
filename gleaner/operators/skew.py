"""A join for keys of very uneven weight.

A key may stand for a third of all rows (a popular text, a full LSH bucket, the centre of a star).  A plain
shuffle join puts them all in one task.  Here the heaviest keys are found first and only their rows are
spread over extra partitions, with the one matching table row copied to each.

The list of heavy keys is written once and broadcast.  A key is heavy when it has more rows than a part shall hold; as
that limit follows the rows of all keys over ``ROWS_PER_SALT``, there are never more than ``PARTS`` heavy keys, and no
other key holds more than 1/PARTS of all rows or ROWS_PER_SALT, whichever is more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.session import materialize

PARTS = 10_000
ROWS_PER_SALT = 250_000


def join_by_heavy_key(
    rows: DataFrame,
    table: DataFrame,
    key: str | Sequence[str],
    weights: DataFrame,
    how: str = "inner",
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Join many ``rows`` to a ``table`` holding each key once.

    ``weights`` gives ``n``, the number of rows, per key; it may be ``table`` itself.  ``how`` is any join
    type that keeps left rows: inner, left, left_semi or left_anti.
    """
    keys = [key] if isinstance(key, str) else list(key)
    per_salt = rows_per_salt or ROWS_PER_SALT
    # Both sides must see the same list, so it is written and not worked out twice.
    seen = Observation("heavy-keys")
    large = weights.filter(F.col("n") > per_salt).select(*keys, "n")
    large = materialize(large.observe(seen, F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")), "heavy-keys")
    if not seen.get["keys"]:  # nothing to spread: the same join without the salts
        return rows.join(table, keys, how)
    per_part = max(per_salt, (seen.get["rows"] or 0) // PARTS)
    hot = large.filter(F.col("n") > per_part).select(*keys, F.ceil(F.col("n") / per_part).alias("_salts"))
    hot = F.broadcast(hot)  # at most PARTS rows of key and number
    others = [c for c in rows.columns if c not in keys]
    spread = F.pmod(F.xxhash64(*(others or keys)), F.col("_salts"))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0).cast("bigint"))).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")) - 1)
    right = table.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
