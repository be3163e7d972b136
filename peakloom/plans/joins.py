"""Joins whose small side is checked, in bytes, before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.plans.durable import shuffles_freed

BROADCAST_BYTES = 16 << 20
# A Parquet byte of a regular table may stand for a row, and a lookup row takes some 64 bytes in a hash
# table. Lookups that grow with the data, or whose rows are multiplied after the scan, have this limit.
GROWING_BYTES = BROADCAST_BYTES // 64
HOT_SHARE = 1.0 / 256
SALTS = 64


def planned_bytes(df: DataFrame) -> int:
    """Size the optimizer expects, an upper bound for scans and aggregates. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows; at most ``1/share`` of them. ``counts`` has a row
    per key and the number of its rows in ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > total * share).select(*on)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: DataFrame | None = None,
    max_bytes: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a lookup keyed by ``on``.

    A lookup of proven size is broadcast, so hot keys in ``facts`` do not matter. Beyond that both
    sides are shuffled, and adaptive execution broadcasts what turns out to be small and splits
    partitions that turn out to be skewed. Keys a caller knows to be ``hot`` are spread over
    ``salts`` tasks and their lookup rows repeated once per salt, so the result is the same.

    Expected sizes count neither the rows that an explode adds nor what Parquet packs; where either may
    matter, ``max_bytes`` (GROWING_BYTES) is a tighter limit, beyond which no broadcast is planned at all.
    """
    on = list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if planned_bytes(dim) <= (BROADCAST_BYTES if max_bytes is None else max_bytes):
        return facts.join(F.broadcast(dim), on, how)
    if max_bytes is not None:
        # the optimizer has the same estimate and would broadcast by it
        dim = dim.hint("merge")
    if facts.isStreaming or hot is None:
        return facts.join(dim, on, how)
    hot = hot.withColumn("_hot", F.lit(True))
    zero = F.lit(0).cast("long")
    # rows that are equal in every column still go to different tasks
    row_hash = F.xxhash64(*([c for c in facts.columns if c not in on] or [zero]), F.spark_partition_id())
    left = facts.withColumn("_at", row_hash).join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.col("_at"), F.lit(salts).cast("long"))).otherwise(zero)
    ).drop("_at")
    every = F.sequence(zero, F.lit(salts - 1).cast("long"))
    right = dim.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(zero)))
    )
    return left.drop("_hot").join(right.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def grown_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the data.

    Written tables pack well, so their files say little about their rows in memory: unless the right one
    is proven tiny both are shuffled and merged, and adaptive execution splits skewed partitions.
    """
    return left.join(right if planned_bytes(right) <= GROWING_BYTES else right.hint("merge"), list(on), how)


def unique(df: DataFrame, *key: str) -> bool:
    """Whether no value of ``key``, null included, occurs twice."""
    with shuffles_freed(df.sparkSession):
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
