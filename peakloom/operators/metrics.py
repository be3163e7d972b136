"""Error, coverage and calibration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.values import (
    SUPPORT_EDGES,
    matrix_category,
    normal_quantile,
    support_bin,
    support_bin_index,
)
from peakloom.plans.joins import lookup_join
from peakloom.plans.ordered import exact_percentiles, running_totals

SUMS = ("n", "sse", "sae", "n_covered", "sum_std", "sum_width")


def error_sums(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable sums over the seen rows."""
    return scored.where("seen").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("err") * F.col("err")).alias("sse"),
        F.sum(F.abs("err")).alias("sae"),
        F.count_if("covered").alias("n_covered"),
        F.sum("pred_std").alias("sum_std"),
        F.sum("width").alias("sum_width"),
    )


def merge_sums(sums: DataFrame, keys: Sequence[str] = (), *extra: Column) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], *extra)


def finish(sums: DataFrame) -> DataFrame:
    """Ratios from sums; an empty group gives nulls."""
    n = F.nullif(F.col("n"), F.lit(0))
    return sums.withColumns(
        {
            "rmse": F.sqrt(F.col("sse") / n),
            "mae": F.col("sae") / n,
            "coverage_95": F.col("n_covered") / n,
            "pred_std_mean": F.col("sum_std") / n,
            "interval_width_mean": F.col("sum_width") / n,
        }
    ).withColumn("n_obs_test", F.coalesce("n", F.lit(0).cast("long"))).drop(*SUMS)


def overall(scored: DataFrame) -> DataFrame:
    """One row of metrics with the exact number of rows read, used and skipped."""
    counts = scored.agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if("seen").alias("n_used"), F.count_if(~F.col("seen")).alias("n_skipped"),
        F.sum(F.when(F.col("seen"), F.col("err") * F.col("err"))).alias("sse"),
        F.sum(F.when(F.col("seen"), F.abs("err"))).alias("sae"),
        F.count_if(F.col("seen") & F.col("covered")).alias("n_covered"),
        F.sum(F.when(F.col("seen"), F.col("pred_std"))).alias("sum_std"),
        F.sum(F.when(F.col("seen"), F.col("width"))).alias("sum_width"),
    )
    return finish(counts.withColumn("n", F.col("n_used"))).drop("n_obs_test")


def by_group(scored: DataFrame, group: str) -> DataFrame:
    """Metrics per (group, comp_id) with the training support carried along."""
    return finish(error_sums(scored, [group, "comp_id", "n_obs_train"]))


def group_rmse_stats(groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distribution of group RMSE: count, mean, population sd, median and upper percentiles."""
    known = groups.where(F.col("rmse").isNotNull() & ~F.isnan("rmse"))
    moments = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rmse"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std")
    )
    tails = exact_percentiles(known, keys, "rmse", {"rmse_p50": 0.5, "rmse_p90": 0.9, "rmse_p99": 0.99})
    if keys:
        return moments.join(tails, list(keys))
    return moments.withColumn("_k", F.lit(1)).join(tails.withColumn("_k", F.lit(1)), ["_k"]).drop("_k")


def by_support(
    scored: DataFrame, coefficients: DataFrame, group: str, edges: Sequence[int] = SUPPORT_EDGES
) -> DataFrame:
    """Metrics by number of training rows of the group; every bin that has groups appears."""
    keys = [group, "comp_id"]
    sums = error_sums(scored, keys)
    size = F.col("n_obs_train")
    table = coefficients.select(
        *keys, F.col("n").alias("n_obs_train")
    ).withColumns({"support_bin": support_bin(size, edges), "bin_idx": support_bin_index(size, edges)})
    joined = table.join(sums, keys, "left")
    bins = ["support_bin", "bin_idx"]
    merged = merge_sums(
        joined, bins, F.count(F.lit(1)).alias("n_groups"), F.count("n").alias("n_groups_with_test")
    )
    stats = group_rmse_stats(joined.withColumn("rmse", F.sqrt(F.col("sse") / F.col("n"))), bins)
    return finish(merged).join(stats.drop("n_rmse"), bins, "left")


def by_common_support(
    scored: DataFrame, mapping: DataFrame, group: str = "species_cluster"
) -> tuple[DataFrame, DataFrame]:
    """(metrics per bin of a given support map, number of rows the map does not cover)."""
    m = mapping.select(F.col("species_cluster").alias(group), "comp_id", "support_bin", "bin_idx")
    seen = scored.where("seen")
    joined = lookup_join(seen, m, [group, "comp_id"], "left")
    missing = joined.agg(F.count_if(F.col("support_bin").isNull()).alias("n_missing"))
    groups = error_sums(joined.where("support_bin IS NOT NULL"), [group, "comp_id", "support_bin", "bin_idx"])
    sizes = mapping.groupBy("support_bin", "bin_idx").agg(F.count(F.lit(1)).alias("n_groups"))
    bins = merge_sums(groups, ["support_bin", "bin_idx"], F.count(F.lit(1)).alias("n_groups_with_test"))
    return finish(sizes.join(bins, ["support_bin", "bin_idx"], "left")), missing


def roll_up_groups(groups: DataFrame, species_map: DataFrame, group: str = "species_cluster") -> DataFrame:
    """Group metrics re-weighted to cluster, category and overall level."""
    labels = species_map.groupBy(F.col("species_cluster").alias(group)).agg(
        F.max("species_group_raw").alias("label"), F.count_distinct("species_group_raw").alias("n_labels")
    )
    if labels.where("n_labels > 1").take(1):
        raise ValueError(f"{group} has several labels")
    n = F.col("n_obs_test")
    joined = lookup_join(groups, labels.drop("n_labels"), [group], "left").withColumns(
        {
            "category": matrix_category(F.coalesce("label", F.lit(""))),
            "_cluster": F.coalesce(group, F.lit(-1).cast("long")),
        }
    )
    sums = joined.rollup("category", "_cluster").agg(
        F.sum(n).alias("n_obs_test"),
        F.sum(F.col("rmse") * F.col("rmse") * n).alias("sse"),
        F.sum(F.col("mae") * n).alias("sae"),
        F.sum(F.col("coverage_95") * n).alias("n_covered"),
        F.sum(F.col("interval_width_mean") * n).alias("sum_width"),
    )
    n = F.nullif(F.col("n_obs_test"), F.lit(0))
    return sums.select(
        "category", F.col("_cluster").alias(group), "n_obs_test",
        F.sqrt(F.col("sse") / n).alias("rmse"), (F.col("sae") / n).alias("mae"),
        (F.col("n_covered") / n).alias("coverage_95"), (F.col("sum_width") / n).alias("interval_width_mean"),
    )


def coverage_at_levels(
    scored: DataFrame, levels: Sequence[float] = (0.5, 0.8, 0.9, 0.95), target: str = "rt"
) -> DataFrame:
    """Share of rows inside central Normal intervals, all levels in one pass."""
    gap = F.abs(F.col(target) - F.col("pred_mean"))
    shares = scored.where("seen").agg(
        *[
            F.avg((gap <= F.lit(normal_quantile(p)) * F.col("pred_std")).cast("double")).alias(f"_c{i}")
            for i, p in enumerate(levels)
        ]
    )
    return shares.select(
        F.inline(F.array(*[F.struct(F.lit(float(p)).alias("nominal"), F.col(f"_c{i}").alias("empirical")) for i, p in enumerate(levels)]))
    )


def error_by_prevalence(scored: DataFrame, unit: str, partner: str) -> DataFrame:
    """Mean absolute error of ``unit`` by its number of distinct partners, pairs weighted equally."""
    pairs = scored.where("seen").groupBy(unit, partner).agg(F.avg(F.abs("err")).alias("abs_err"))
    units = pairs.groupBy(unit).agg(F.avg("abs_err").alias("abs_err"), F.count(F.lit(1)).alias("prevalence"))
    n = F.col("prevalence")
    name = F.when(n <= 2, "<=2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    return units.groupBy(name.alias("prevalence_bin")).agg(
        F.avg("abs_err").alias("mean_abs_err"), F.count(F.lit(1)).alias("n_units")
    )


def effect_sizes(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Absolute mean difference between labels over the pooled sample sd, per feature."""
    when = lambda f, v: F.when(F.col(label) == v, F.col(f))
    one = df.agg(
        *[
            g(when(f, v)).alias(f"_{s}{v}_{i}")
            for i, f in enumerate(features)
            for v in (0, 1)
            for s, g in (("m", F.avg), ("s", F.stddev_samp))
        ]
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            (
                F.abs(F.col(f"_m1_{i}") - F.col(f"_m0_{i}"))
                / F.nullif(F.sqrt((F.pow(f"_s1_{i}", F.lit(2)) + F.pow(f"_s0_{i}", F.lit(2))) / 2), F.lit(0.0))
            ).alias("effect"),
        )
        for i, f in enumerate(features)
    ]
    return one.select(F.inline(F.array(*rows))).where("effect IS NOT NULL")


# -- probability calibration ---------------------------------------------------------------------


def expected_calibration_error(
    pairs: DataFrame, keys: Sequence[str] = (), n_bins: int = 10, p: str = "p", y: str = "y"
) -> DataFrame:
    """ECE over right-closed bins (the first one closed on both sides)."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    slot = F.greatest(F.lit(1), F.ceil(q * F.lit(float(n_bins))).cast("int"))
    bins = pairs.select(*keys, q.alias("_q"), F.col(y).cast("double").alias("_y"), slot.alias("_bin")).groupBy(
        *keys, "_bin"
    ).agg(F.count(F.lit(1)).alias("_n"), F.avg("_q").alias("_q"), F.avg("_y").alias("_y"))
    return bins.groupBy(*keys).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_q") - F.col("_y"))) / F.sum("_n")).alias("ece"),
        F.sum("_n").alias("n_pairs"),
    )


def macro_calibration_error(pairs: DataFrame, cls: str = "compound_id") -> DataFrame:
    """Mean of the per-class calibration errors."""
    return expected_calibration_error(pairs, [cls]).agg(F.avg("ece").alias("ece_ovr"))


def reliability_curve(pairs: DataFrame, n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Predicted against observed frequency over left-closed bins (the last one closed)."""
    slot = F.least(F.lit(n_bins - 1), F.floor(F.col(p) * F.lit(float(n_bins))).cast("int"))
    return pairs.groupBy(slot.alias("bin")).agg(
        F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n")
    )


def brier(pairs: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    return pairs.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier_ovr"))


def curve_points(pairs: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One point per distinct score: cumulative counts, ROC and precision-recall coordinates."""
    steps = pairs.groupBy((-F.col(p)).alias("_neg")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_negn")
    )
    ranked = running_totals(steps, [], ["_neg"], {"tp": "_pos", "fp": "_negn"})
    return ranked.select(
        (-F.col("_neg")).alias("threshold"), "tp", "fp", "tp_total", "fp_total", "_pos", "_negn",
        (F.col("tp") / F.nullif("tp_total", F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif("fp_total", F.lit(0))).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif("tp_total", F.lit(0))).alias("recall"),
    )


def curve_areas(points: DataFrame) -> DataFrame:
    """Trapezoid areas under both curves; each point knows its predecessor from its own step."""
    prev_tp, prev_fp = F.col("tp") - F.col("_pos"), F.col("fp") - F.col("_negn")
    positives, negatives = F.col("tp_total"), F.col("fp_total")
    roc = F.col("_negn") * (F.col("tp") + prev_tp) / 2.0 / positives / negatives
    before = F.when(prev_tp + prev_fp == 0, 1.0).otherwise(prev_tp / F.nullif(prev_tp + prev_fp, F.lit(0)))
    pr = F.col("_pos") / positives * (F.col("precision") + before) / 2.0
    return points.agg(F.sum(roc).alias("roc_auc"), F.sum(pr).alias("pr_auc"))
