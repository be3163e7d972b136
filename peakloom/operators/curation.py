"""Peak selection inside a sample set: window filter, correction factor, coherence mixture."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.values import normal_quantile
from peakloom.plans.durable import discard, stored
from peakloom.plans.joins import lookup_join
from peakloom.plans.ordered import exact_percentiles

SET_KEYS = ["sample_set_id", "compound_id"]


def select_peaks(peaks: DataFrame, buffer: float = 0.02) -> DataFrame:
    """One peak per (sample set, task, compound) after drift correction.

    ``peaks`` holds sample_set_id, task_id, compound_id, peak_id, rt, rt_mean and half_width.
    Peaks outside their window go; the correction factor is the median shift of the compound in
    the sample set; the peak closest to the corrected centre stays, unless it is off by more than
    ``buffer``.
    """
    inside = peaks.where(F.abs(F.col("rt") - F.col("rt_mean")) <= F.col("half_width")).withColumn(
        "delta", F.col("rt_mean") - F.col("rt")
    )
    if _large_group(inside):
        inside = stored(inside)
        factors = exact_percentiles(inside, SET_KEYS, "delta", {"correction": 0.5})
        moved = lookup_join(inside, factors, SET_KEYS, "inner")
    else:
        # dealt once by sample set and compound; the median and the best peak of a task need no other shuffle
        moved = _with_median(inside.where(" AND ".join(f"{k} IS NOT NULL" for k in SET_KEYS)).repartition(*SET_KEYS))
    moved = moved.withColumn("offset", F.abs(F.col("delta") - F.col("correction")))
    rest = [c for c in moved.columns if c not in ("sample_set_id", "task_id", "compound_id", "offset", "peak_id")]
    best = moved.groupBy("sample_set_id", "task_id", "compound_id").agg(F.min(F.struct("offset", "peak_id", *rest)).alias("_b"))
    kept = best.select("sample_set_id", "task_id", "compound_id", "_b.*")
    return kept.where(F.col("offset") <= buffer)


# Peaks of a sample set and compound that one task orders on its own.
GROUP_ROWS = 200_000


def _large_group(inside: DataFrame) -> bool:
    """Whether a (sample set, compound) has more than GROUP_ROWS peaks."""
    sizes = inside.groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.where(F.col("_n") > GROUP_ROWS).isEmpty()


def _with_median(inside: DataFrame) -> DataFrame:
    """Rows with ``correction``, the median of ``delta`` of their group as exact_percentiles works it out."""
    group = Window.partitionBy(*SET_KEYS)
    last = F.count("delta").over(group) - 1
    numbered = inside.withColumns({"_at": F.row_number().over(group.orderBy("delta")) - 1, "_pos": F.lit(0.5) * last})
    low, high = (F.max(F.when(F.col("_at") == at, F.col("delta"))).over(group) for at in (F.floor("_pos"), F.ceil("_pos")))
    found = numbered.withColumns({"_low": low, "_high": high})
    median = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - F.floor("_pos"))
    return found.withColumn("correction", median).drop("_at", "_pos", "_low", "_high")


def coherence_scores(selected: DataFrame, level: float = 0.95) -> DataFrame:
    """(sample_set_id, compound_id, x, n_tasks): mean retention log-likelihood over tasks."""
    sigma = F.col("half_width") / F.lit(normal_quantile(level))
    z = (F.col("delta") - F.col("correction")) / sigma
    loglik = F.lit(-0.5) * (z * z + F.log(sigma * sigma))
    return selected.groupBy(*SET_KEYS).agg(F.avg(loglik).alias("x"), F.count(F.lit(1)).alias("n_tasks"))


# Dirichlet concentration of the mixture weights and the variance regulariser.
WEIGHT_PRIOR = 0.5
VARIANCE_FLOOR = 1e-6
# Compounds of a sample set that one task goes through on its own.
SET_ROWS = 50_000


def _log_normal(x, mean, var):
    return F.lit(-0.5) * (F.log(F.lit(2 * math.pi) * var) + (x - mean) * (x - mean) / var)


def coherence_mixture(
    scores: DataFrame, iterations: int = 20_000, tolerance: float = 1e-6, set_rows: int = SET_ROWS
) -> DataFrame:
    """Two-component Gaussian mixture of the scores within every sample set.

    A set of up to ``set_rows`` compounds goes through its rounds in one task; for larger ones
    expectation and maximisation are joins and sums, so the size of a set does not matter. Components start below and above the mean; the coherent one is the
    heavier (the higher mean on a tie). Adds posterior_coherent, rejected, the parameters and
    ``converged``. A set is left alone once its parameters move less than ``tolerance``; those that
    still move after ``iterations`` rounds have ``converged`` false.
    """
    base = stored(scores.where(F.col("x").isNotNull()))
    start = base.groupBy("sample_set_id").agg(F.avg("x").alias("mid"), F.count(F.lit(1)).alias("size"))
    first = lookup_join(base, start, ["sample_set_id"], "inner").withColumn("r", (F.col("x") >= F.col("mid")).cast("double"))
    fields = "mu0 double, var0 double, w0 double, mu1 double, var1 double, w1 double, converged boolean"
    schema = f"sample_set_id {dict(base.dtypes)['sample_set_id']}, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]
    few = first.where(F.col("size") <= set_rows).select("sample_set_id", "x", "r")
    solved = few.groupBy("sample_set_id").applyInPandas(_mixture_of_set(iterations, tolerance, names), schema)
    many = stored(first.where(F.col("size") > set_rows))
    params = stored(solved.select("sample_set_id", *names))
    if not many.isEmpty():
        params = params.unionByName(_mixture_by_sums(many, iterations, tolerance).select("sample_set_id", *names))
    final = _responsibility(base, params)
    second = (F.col("w1") > F.col("w0")) | ((F.col("w1") == F.col("w0")) & (F.col("mu1") >= F.col("mu0")))
    p = F.when(second, F.col("r")).otherwise(1.0 - F.col("r"))
    return final.withColumns(
        {"coherent_component": second.cast("int"), "posterior_coherent": p, "rejected": p < 0.5}
    ).drop("r")


def _mixture_of_set(iterations: int, tolerance: float, names):
    """The rounds of one small set."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, r = pdf["x"].to_numpy(float), pdf["r"].to_numpy(float)
        mean, spread, n = x.mean(), x.var(), len(x)

        def maximise(r):
            out = []
            for share in (1.0 - r, r):
                total = share.sum()
                m = (share @ x) / total if total > 1e-9 else mean
                v = (share @ (x * x)) / total - m * m if total > 1e-9 else spread
                out += [m, max(v, 0.0) + VARIANCE_FLOOR, (total + WEIGHT_PRIOR) / (n + 2 * WEIGHT_PRIOR)]
            return np.array(out)

        now, converged = maximise(r), False
        for _ in range(iterations):
            m0, v0, w0, m1, v1, w1 = now
            gap = np.log(w0) - np.log(w1) - 0.5 * (np.log(v0) + (x - m0) ** 2 / v0) + 0.5 * (np.log(v1) + (x - m1) ** 2 / v1)
            new = maximise(1.0 / (1.0 + np.exp(np.minimum(gap, 700.0))))
            converged = bool(np.abs(new - now)[[0, 3, 5]].max() < tolerance)
            now = new
            if converged:
                break
        return pd.DataFrame([(pdf["sample_set_id"].iloc[0], *now, converged)], columns=["sample_set_id", *names])

    return solve


def _mixture_by_sums(first: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """The rounds of large sets, all at once; a set is left alone once it has converged."""
    params = stored(_maximise(first).withColumn("converged", F.lit(False)))
    names = ("mu0", "mu1", "w1")
    base = first.drop("r", "mid", "size")
    for _ in range(iterations):
        old = params.select("sample_set_id", *[F.col(c).alias(f"_{c}") for c in names])
        step = _maximise(_responsibility(base, params.where("NOT converged")))
        moved = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in names])
        new = lookup_join(step, old, ["sample_set_id"], "inner").withColumn("converged", moved < tolerance).drop(*[f"_{c}" for c in names])
        last, params = params, stored(params.where("converged").unionByName(new))
        discard(last)
        if params.where("NOT converged").isEmpty():
            break
    return params


def _responsibility(base: DataFrame, params: DataFrame) -> DataFrame:
    joined = lookup_join(base, params, ["sample_set_id"], "inner")
    l0 = F.log("w0") + _log_normal(F.col("x"), F.col("mu0"), F.col("var0"))
    l1 = F.log("w1") + _log_normal(F.col("x"), F.col("mu1"), F.col("var1"))
    return joined.withColumn("r", 1.0 / (1.0 + F.exp(F.least(l0 - l1, F.lit(700.0)))))


def _maximise(rows: DataFrame) -> DataFrame:
    """Weights, means and variances from responsibilities ``r`` of the second component."""
    r, x = F.col("r"), F.col("x")
    s = rows.groupBy("sample_set_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("n1"), F.sum(r * x).alias("s1"), F.sum(r * x * x).alias("q1"),
        F.sum(1 - r).alias("n0"), F.sum((1 - r) * x).alias("s0"), F.sum((1 - r) * x * x).alias("q0"),
        F.avg("x").alias("m"), F.var_pop("x").alias("v"),
    )
    out = {}
    for k in ("0", "1"):
        n = F.col(f"n{k}")
        mean = F.when(n > 1e-9, F.col(f"s{k}") / n).otherwise(F.col("m"))
        var = F.when(n > 1e-9, F.col(f"q{k}") / n - mean * mean).otherwise(F.col("v"))
        out[f"mu{k}"] = mean
        out[f"var{k}"] = F.greatest(var, F.lit(0.0)) + F.lit(VARIANCE_FLOOR)
        out[f"w{k}"] = (n + WEIGHT_PRIOR) / (F.col("n") + 2 * WEIGHT_PRIOR)
    return s.select("sample_set_id", *[c.alias(name) for name, c in out.items()])


def drop_incoherent(selected: DataFrame, mixture: DataFrame) -> DataFrame:
    """Selected peaks without the compounds rejected in their sample set."""
    rejected = mixture.where("rejected").select(*SET_KEYS)
    return lookup_join(selected, rejected, SET_KEYS, "left_anti")
