"""Per-group selection without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: Sequence[str | Column],
    salts: int = 64,
    rank: str | None = None,
) -> DataFrame:
    """First ``k`` rows of every group in ``order``.

    A first cut per (group, salt) leaves at most ``k`` rows per salt, so the final ranking of a
    hot group sees ``k * salts`` rows. Exact: a row outside the first k of its salt slice cannot
    be among the first k of the group.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    out = rank or "_rank"
    kept = (
        salted.withColumn("_cut", F.row_number().over(first))
        .where(F.col("_cut") <= k)
        .drop("_cut", "_salt")
        .withColumn(out, F.row_number().over(last))
        .where(F.col(out) <= k)
    )
    return kept if rank else kept.drop(out)
