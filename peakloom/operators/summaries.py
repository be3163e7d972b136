"""Row and pair counts of the training tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.values import SUPPORT_EDGES, support_bin, support_bin_index
from peakloom.plans.joins import lookup_join


def pair_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key combination, combinations with a null dropped."""
    usable = df.select(*keys)
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    return usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def species_rollup(pairs: DataFrame, species: str, compound: str = "comp_id") -> DataFrame:
    """Compounds and rows per species, from unique (species, compound) rows."""
    return pairs.groupBy(species).agg(
        F.count(compound).alias("n_compounds"), F.sum("n_rows").alias("n_rows")
    ).orderBy(species)


def cap_totals(pairs: DataFrame, caps: Sequence[int] = (10, 20, 50, 100)) -> DataFrame:
    """Rows that would remain under each cap."""
    one = pairs.agg(*[F.sum(F.least("n_rows", F.lit(c))).alias(f"_{c}") for c in caps])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("cap"), F.col(f"_{c}").alias("n_rows")) for c in caps]))
    )


def cap_summary(
    df: DataFrame, full: DataFrame, species: str = "species", compound: str = "comp_id",
    cluster: str = "species_cluster",
) -> DataFrame:
    """Rows and distinct pairs per (lib, cap), overall and by cluster (null cluster = overall).

    ``full`` holds (lib, n_full); the percentage is only given for the overall rows.
    """
    fine = df.groupBy("lib", "cap", cluster, species, compound).agg(F.count(F.lit(1)).alias("n"))
    per_cluster = fine.groupBy("lib", "cap", cluster).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs")
    )
    whole = (
        fine.groupBy("lib", "cap", species, compound).agg(F.sum("n").alias("n"))
        .groupBy("lib", "cap").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"))
    )
    pct = F.when(F.col("n_full") > 0, F.round(F.col("n_rows") / F.col("n_full") * 100, 2))
    whole = lookup_join(whole, full, ["lib"], "left").withColumn("rows_pct_of_full", pct).drop("n_full")
    return whole.unionByName(per_cluster, allowMissingColumns=True)


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def support_histogram(
    df: DataFrame, group: str = "species_cluster", edges: Sequence[int] = SUPPORT_EDGES
) -> DataFrame:
    """Training rows and support bin per (group, comp_id)."""
    counts = pair_counts(df, [group, "comp_id"])
    return counts.withColumns(
        {"support_bin": support_bin("n_rows", edges), "bin_idx": support_bin_index("n_rows", edges)}
    )
