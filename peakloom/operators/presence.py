"""Presence priors: Beta counts per (species, compound) and for the null class.

The table is sparse: a missing row stands for the smoothing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.values import log_prior
from peakloom.plans.joins import grown_join

NEGATIVE_WEIGHT = 0.25  # Fixed value: what a rejected alternative adds to beta.


def initial_prior(observed: DataFrame | None, smoothing: float = 1.0) -> DataFrame | None:
    """(species, compound_id, alpha, beta): smoothing plus empirical counts."""
    if observed is None:
        return None
    return observed.groupBy("species", "compound_id").agg(
        (F.lit(float(smoothing)) + F.count(F.lit(1))).alias("alpha"), F.lit(float(smoothing)).alias("beta")
    )


def batch_update(labelled: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(compound prior, null prior) from labelled peaks (species, compound_id; null id = noise).

    A compound counts once per species however often it was labelled. Null and non-null counts
    enter through log1p per species, so that many noise peaks do not drown the prior.
    """
    prior = labelled.where(F.col("compound_id").isNotNull()).select("species", "compound_id").distinct().select(
        "species", "compound_id", F.lit(smoothing + 1.0).alias("alpha"), F.lit(float(smoothing)).alias("beta")
    )
    counts = labelled.groupBy("species").agg(
        F.count_if(F.col("compound_id").isNull()).alias("n_null"), F.count("compound_id").alias("n_known")
    )
    null = counts.agg(
        (F.lit(float(smoothing)) + F.coalesce(F.sum(F.log1p("n_null")), F.lit(0.0))).alias("alpha_null"),
        (F.lit(float(smoothing)) + F.coalesce(F.sum(F.log1p("n_known")), F.lit(0.0))).alias("beta_null"),
    )
    return prior, null


def label_events(labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Increments of interactive labels: (species, compound_id, d_alpha, d_beta).

    ``labels`` holds (peak_id, species, compound_id), a null compound meaning noise. The chosen
    compound gains one, the peak's other candidates are lightly rejected. Null-class increments
    come back with a null species and compound.
    """
    chosen = labels.select(F.col("peak_id"), F.col("species"), F.col("compound_id").alias("_choice"))
    positive = chosen.where("_choice IS NOT NULL").select(
        "species", F.col("_choice").alias("compound_id"), F.lit(1.0).alias("d_alpha"), F.lit(0.0).alias("d_beta")
    )
    others = grown_join(candidates.select("peak_id", "compound_id"), chosen.where("_choice IS NOT NULL"), ["peak_id"])
    negative = others.where(F.col("compound_id") != F.col("_choice")).select(
        "species", "compound_id", F.lit(0.0).alias("d_alpha"), F.lit(NEGATIVE_WEIGHT).alias("d_beta")
    )
    noise = F.col("_choice").isNull()
    null = chosen.select(
        F.lit(None).cast("long").alias("species"), F.lit(None).cast("long").alias("compound_id"),
        noise.cast("double").alias("d_alpha"), (~noise).cast("double").alias("d_beta"),
    )
    every = positive.unionByName(negative).unionByName(null)
    return every.groupBy("species", "compound_id").agg(F.sum("d_alpha").alias("d_alpha"), F.sum("d_beta").alias("d_beta"))


def apply_events(prior: DataFrame, events: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Prior plus increments (sums commute, so the order of labels does not matter)."""
    moves = events.where(F.col("species").isNotNull())
    base = prior.select("species", "compound_id", (F.col("alpha") - smoothing).alias("d_alpha"), (F.col("beta") - smoothing).alias("d_beta"))
    return base.unionByName(moves).groupBy("species", "compound_id").agg(
        (F.sum("d_alpha") + smoothing).alias("alpha"), (F.sum("d_beta") + smoothing).alias("beta")
    )


def apply_null_events(null: DataFrame, events: DataFrame) -> DataFrame:
    move = events.where(F.col("species").isNull()).agg(
        F.coalesce(F.sum("d_alpha"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("d_beta"), F.lit(0.0)).alias("b")
    )
    both = null.unionByName(move.select(F.col("a").alias("alpha_null"), F.col("b").alias("beta_null")))
    return both.agg(F.sum("alpha_null").alias("alpha_null"), F.sum("beta_null").alias("beta_null"))


def log_null(null: DataFrame) -> float:
    """Log prior of the null class (one number)."""
    return null.select(log_prior("alpha_null", "beta_null").alias("v")).first()["v"]
