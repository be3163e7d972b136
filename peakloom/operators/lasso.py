"""Lasso per group, solved from sufficient statistics per (group, fold).

Rows are reduced to one matrix row per group and fold; training statistics of a fold are the
group's total minus the fold, so cross-validation never revisits the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.values import feature_value, hash_text
from peakloom.operators.sums import STAT_COLUMNS, group_sums
from peakloom.plans.joins import lookup_join

# Penalty without cross-validation, size and ratio of the penalty path.
SMALL_GROUP_ALPHA = 0.01
PATH_LENGTH = 100
PATH_RATIO = 1e-3
CV_MINIMUM = 5


def coordinate_descent(
    gram: np.ndarray, c: np.ndarray, alpha: np.ndarray, w: np.ndarray, sweeps: int = 100_000, tolerance: float = 1e-10
) -> tuple[np.ndarray, np.ndarray]:
    """(w, converged): minimise w'Gw/2 - c'w + alpha |w|_1 for a stack of problems at once.

    Columns without variance stay at zero. A problem has converged when a sweep moves none of its
    weights by ``tolerance``, or when the signs found so far lead to the optimum at once; problems
    that have are not swept again.
    """
    w = w.copy()
    done = np.zeros(len(w), dtype=bool)
    diag = np.einsum("gii->gi", gram)
    safe = np.where(diag > 1e-12, diag, 1.0)
    for sweep in range(sweeps):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        if sweep in _POLISH:
            w[at], done[at] = _polish(gram[at], c[at], alpha[at], w[at], tolerance)
            at = np.flatnonzero(~done)
            if not len(at):
                break
        moved, v = np.zeros(len(at)), w[at]
        for j in range(w.shape[1]):
            r = c[at, j] - np.einsum("gi,gi->g", gram[at, j], v) + diag[at, j] * v[:, j]
            new = np.where(diag[at, j] > 1e-12, np.sign(r) * np.maximum(np.abs(r) - alpha[at], 0.0) / safe[at, j], 0.0)
            moved = np.maximum(moved, np.abs(new - v[:, j]))
            v[:, j] = new
        w[at] = v
        done[at] = moved < tolerance
    return w, done


_POLISH = {5, 20, 60, 200, 600, 2_000, 6_000, 20_000, 60_000}


def _polish(gram, c, alpha, w, tolerance):
    """(w, solved): solve for the weights that are not zero, given their signs, and keep the result
    where the signs hold and no other feature should enter."""
    on, sign = w != 0.0, np.sign(w)
    both = on[:, :, None] & on[:, None, :]
    left = np.where(both, gram, 0.0) + np.einsum("gi,ij->gij", (~on).astype(float), np.eye(w.shape[1]))
    right = np.where(on, c - alpha[:, None] * sign, 0.0)
    new = np.einsum("gij,gj->gi", np.linalg.pinv(left, rcond=1e-13, hermitian=True), right)
    new = np.where(on, new, 0.0)
    slack = np.abs(c - np.einsum("gij,gj->gi", gram, new))
    inside = np.where(on, np.abs(slack - alpha[:, None]) <= 1e-9, slack <= alpha[:, None] + tolerance)
    good = (inside | (np.einsum("gii->gi", gram) <= 1e-12)).all(axis=1) & ((np.sign(new) == sign) | ~on).all(axis=1)
    return np.where(good[:, None], new, w), good


def _centred(s: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(x mean, y mean, xtx, xty, yty) of stacked statistics; empty entries give zeros."""
    n = np.maximum(s["n"], 1.0)
    xm, ym = s["sum_x"] / n[..., None], s["sum_y"] / n
    xtx = s["sum_xx"] - s["n"][..., None, None] * xm[..., :, None] * xm[..., None, :]
    xty = s["sum_xy"] - (s["n"] * ym)[..., None] * xm
    return xm, ym, xtx, xty, s["sum_yy"] - s["n"] * ym * ym


def solve_groups(folds: dict[str, np.ndarray], alpha: float | None) -> tuple[np.ndarray, ...]:
    """(intercept, slopes, alpha, converged) for stacked groups; ``folds`` arrays are [group, fold, ...].

    Features are scaled to unit variance over the whole group before the penalty applies; the
    penalty with the least mean fold error is kept.
    """
    total = {k: v.sum(axis=1) for k, v in folds.items()}
    n = total["n"]
    xm, ym, a, c, _ = _centred(total)
    variance = np.einsum("gii->gi", a) / n[:, None]
    # a feature that varies by less than the rounding of its sums is constant and stays out
    keep = variance > 1e-10 * np.einsum("gii->gi", total["sum_xx"]) / n[:, None]
    scale = np.sqrt(np.where(keep, variance, 1.0))
    a, c = a * (keep[:, :, None] & keep[:, None, :]), c * keep
    pair = scale[:, :, None] * scale[:, None, :]
    gram, lin = a / pair / n[:, None, None], c / scale / n[:, None]
    groups, k = folds["n"].shape
    p = xm.shape[1]
    best = np.full(groups, SMALL_GROUP_ALPHA if alpha is None else alpha)

    cv = n >= CV_MINIMUM
    if cv.any():
        top = np.maximum(np.abs(lin).max(axis=1), 1e-12)
        grid = np.geomspace(1.0, PATH_RATIO, PATH_LENGTH)
        rest = {name: total[name][:, None] - v for name, v in folds.items()}
        rm, ry, rg, rv, _ = _centred(rest)
        tm, ty, tg, tv, tq = _centred(folds)
        rn = np.maximum(rest["n"], 1.0)
        used = (folds["n"] > 0) & (rest["n"] > 0)
        rg = rg / pair[:, None] / rn[..., None, None]
        rv = rv / scale[:, None] / rn[..., None]
        tg, tv = tg / pair[:, None], tv / scale[:, None]
        both = (keep[:, :, None] & keep[:, None, :])[:, None]
        rg, tg, rv, tv = rg * both, tg * both, rv * keep[:, None], tv * keep[:, None]
        step = (tm - rm) / scale[:, None] * keep[:, None]
        w = np.zeros((groups * k, p))
        errors = np.empty((groups, PATH_LENGTH))
        for i, share in enumerate(grid):
            w, _ = coordinate_descent(rg.reshape(-1, p, p), rv.reshape(-1, p), np.repeat(top * share, k), w)
            u = w.reshape(groups, k, p)
            shift = (ty - ry) - (step * u).sum(-1)
            spread = tq - 2 * (u * tv).sum(-1) + np.einsum("gki,gkij,gkj->gk", u, tg, u)
            mse = spread / np.maximum(folds["n"], 1.0) + shift * shift
            errors[:, i] = np.where(used, mse, 0.0).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
        best = np.where(cv, top * grid[errors.argmin(axis=1)], best)
    w, done = coordinate_descent(gram, lin, best, np.zeros((groups, p)))
    w = w / scale
    return ym - (xm * w).sum(axis=1), w, best, done


def fit_lasso(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], row_key: Sequence[str | Column], target: str = "rt",
    folds: int = 5, alpha: float | None = None, min_samples: int = 3, seed: int = 42,
) -> DataFrame:
    """(keys, intercept, coef, alpha, n, converged): cross-validated penalty from five rows on, a fixed one
    below; groups under ``min_samples`` get no model. Folds are a hash of the row's own key."""
    fold = F.pmod(F.conv(F.substring(hash_text(row_key, seed), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    sums = group_sums(df.withColumn("_fold", fold), [*keys, "_fold"], features, target)
    # at most ``folds`` rows per group
    packed = sums.groupBy(*keys).agg(F.sum("n").alias("_total"), F.array_sort(F.collect_list(F.struct("_fold", *STAT_COLUMNS))).alias("folds"))
    packed = packed.where(F.col("_total") >= min_samples).drop("_total")
    p = len(features)
    schema = T.StructType(
        [*[sums.schema[k] for k in keys], T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
         T.StructField("alpha", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("converged", T.BooleanType())]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            shapes = {"n": (), "sum_x": (p,), "sum_y": (), "sum_yy": (), "sum_xx": (p, p), "sum_xy": (p,)}
            stacked = {c: np.zeros((len(pdf), folds, *shape)) for c, shape in shapes.items()}
            for g, parts in enumerate(pdf["folds"]):
                for f in parts:
                    for c, shape in shapes.items():
                        stacked[c][g, f["_fold"]] = np.reshape(f[c], shape)
            b, w, best, done = solve_groups(stacked, alpha)
            yield pd.concat(
                [
                    pdf[list(keys)],
                    pd.DataFrame(
                        {"intercept": b, "coef": list(w), "alpha": best, "n": stacked["n"].sum(axis=1).astype("int64"), "converged": done}, index=pdf.index
                    ),
                ],
                axis=1,
            )

    return packed.mapInPandas(solve, schema)


def predict_lasso(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """pred_mean per row, null where no model was fitted."""
    joined = lookup_join(rows, models.select(*keys, F.col("intercept").alias("_b"), F.col("coef").alias("_w")), list(keys), "left")
    mean = F.col("_b")
    for i, f in enumerate(features):
        mean = mean + F.get("_w", F.lit(i)) * feature_value(f, rows.columns)
    return joined.withColumn("pred_mean", mean).drop("_b", "_w")


def with_species_profile(df: DataFrame, runs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Replace row covariates by the mean over the runs of the species."""
    means = runs.groupBy("species").agg(*[F.avg(f).alias(f) for f in features])
    return lookup_join(df.drop(*features), means, ["species"], "inner")
