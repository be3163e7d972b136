"""Ridge models solved from group statistics: one small dense solve per row of the group table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.operators import sums as S
from peakloom.plans.durable import stored

VECTOR = T.ArrayType(T.DoubleType())
JITTER = 1e-12
# Prior shape and rate of the noise variance.
NOISE_SHAPE = 2.0
NOISE_RATE = 1e-6


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of every matrix in a stack; singular ones, and only those, get their pseudo-inverse."""
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.stack([_inverse_of_one(m) for m in a])


def _inverse_of_one(m: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m, hermitian=True)


def _stack(column: pd.Series, *shape: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(float).reshape(len(column), *shape)


def _solve_rows(
    stats: DataFrame, keep: Sequence[str], outputs: Sequence[T.StructField],
    solve: Callable[[pd.DataFrame], dict[str, object]],
) -> DataFrame:
    """Apply a stacked numpy solve to every batch of group rows, keeping the key columns."""
    schema = T.StructType([*[stats.schema[k] for k in keep], *outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pdf[list(keep)], pd.DataFrame(solve(pdf), index=pdf.index)], axis=1)

    return stats.mapInPandas(run, schema)


def _penalty(penalty: float | Sequence[float], p: int) -> np.ndarray:
    diag = np.full(p, float(penalty)) if np.isscalar(penalty) else np.asarray(penalty, float)
    if diag.shape != (p,) or not np.all(np.isfinite(diag)) or np.any(diag <= 0):
        raise ValueError(f"penalty must be {p} positive finite numbers")
    return diag


# -- ridge and Bayesian ridge --------------------------------------------------------------------


def ridge(stats: DataFrame, keys: Sequence[str], p: int, penalty: float) -> DataFrame:
    """Slopes, intercept and residual sigma per group; the intercept is not penalised."""

    def solve(pdf):
        a0, c = _stack(pdf["xtx"], p, p), _stack(pdf["xty"], p)
        w = np.einsum("gij,gj->gi", _inverse(a0 + penalty * np.eye(p)), c)
        fit = np.einsum("gi,gij,gj->g", w, a0, w)
        sse = np.maximum(pdf["yty"] - 2 * (w * c).sum(1) + fit, 0.0)
        b = pdf["y_mean"] - (w * _stack(pdf["x_mean"], p)).sum(1)
        return {"intercept": b, "coef": list(w), "sigma": np.sqrt(sse / pdf["n"])}

    out = [
        T.StructField("intercept", T.DoubleType()), T.StructField("coef", VECTOR),
        T.StructField("sigma", T.DoubleType()),
    ]
    return _solve_rows(stats, [*keys, "n"], out, solve)


def bayesian_ridge(stats: DataFrame, keys: Sequence[str], p: int, penalty: float) -> DataFrame:
    """Ridge plus the diagonal of the inverse, the expected noise variance and the feature means."""

    def solve(pdf):
        a0, c = _stack(pdf["xtx"], p, p), _stack(pdf["xty"], p)
        x_mean = _stack(pdf["x_mean"], p)
        inv = _inverse(a0 + penalty * np.eye(p))
        w = np.einsum("gij,gj->gi", inv, c)
        fit = np.einsum("gi,gij,gj->g", w, a0, w)
        sse = np.maximum(pdf["yty"] - 2 * (w * c).sum(1) + fit, 0.0)
        rate = NOISE_RATE + 0.5 * np.maximum(pdf["yty"] - (w * c).sum(1), 0.0)
        return {
            "intercept": pdf["y_mean"] - (w * x_mean).sum(1),
            "coef": list(w),
            "sigma": np.sqrt(sse / pdf["n"]),
            "sigma2_mean": rate / (NOISE_SHAPE + 0.5 * pdf["n"] - 1.0),
            "v_diag": list(np.einsum("gii->gi", inv)),
            "x_mean": list(x_mean),
        }

    out = [
        T.StructField("intercept", T.DoubleType()), T.StructField("coef", VECTOR),
        T.StructField("sigma", T.DoubleType()), T.StructField("sigma2_mean", T.DoubleType()),
        T.StructField("v_diag", VECTOR), T.StructField("x_mean", VECTOR),
    ]
    return _solve_rows(stats, [*keys, "n"], out, solve)


def train_two_grain(
    df: DataFrame, features: Sequence[str], penalty: float, target: str = "rt",
    group: str = "supercategory", compound: str = "comp_id",
) -> tuple[DataFrame, DataFrame]:
    """(group x compound, compound only) Bayesian ridge tables from one pass over the rows."""
    middle, level = S.global_means(df, features, target)
    fine, coarse = S.two_grains(df, [group, compound], [compound], features, target, middle, level)
    p = len(features)
    return (
        bayesian_ridge(S.centred(fine, center=middle, target_center=level), [group, compound], p, penalty),
        bayesian_ridge(S.centred(coarse, center=middle, target_center=level), [compound], p, penalty),
    )


# -- posterior summaries -------------------------------------------------------------------------

_POSTERIOR = [
    T.StructField("beta_hat", VECTOR), T.StructField("beta_var_diag", VECTOR), T.StructField("beta_cov", VECTOR),
    T.StructField("sigma2_mean", T.DoubleType()),
]


def group_posterior(
    stats: DataFrame, keys: Sequence[str], p: int, penalty: float | Sequence[float],
    sigma2: float | None = None, slope_mean: str | None = None,
) -> DataFrame:
    """Mean and full covariance of (intercept, slopes) with a flat intercept prior.

    ``sigma2`` is a shared noise variance; without it every group uses its own expected variance.
    ``slope_mean`` names an array column to shrink the slopes towards.
    """
    diag = _penalty(penalty, p)

    def solve(pdf):
        a0, c = _stack(pdf["xtx"], p, p), _stack(pdf["xty"], p)
        x_mean, n = _stack(pdf["x_mean"], p), pdf["n"].to_numpy(float)
        m = _stack(pdf[slope_mean], p) if slope_mean else np.zeros_like(c)
        inv = _inverse(a0 + np.diag(diag + JITTER))
        w = m + np.einsum("gij,gj->gi", inv, c - np.einsum("gij,gj->gi", a0, m))
        if sigma2 is None:
            rate = NOISE_RATE + 0.5 * np.maximum(pdf["yty"].to_numpy() - (w * c).sum(1), 0.0)
            s2 = rate / (NOISE_SHAPE + 0.5 * n - 1.0)
        else:
            s2 = np.full(len(pdf), float(sigma2))
        pull = np.einsum("gij,gj->gi", inv, x_mean)
        cov = np.empty((len(pdf), p + 1, p + 1))
        cov[:, 0, 0] = 1.0 / np.maximum(n, 1.0) + (x_mean * pull).sum(1)
        cov[:, 0, 1:] = cov[:, 1:, 0] = -pull
        cov[:, 1:, 1:] = inv
        cov *= s2[:, None, None]
        b = pdf["y_mean"].to_numpy() - (w * x_mean).sum(1)
        return _summary(np.column_stack([b, w]), cov, s2)

    return _solve_rows(stats, [*keys, "n"], _POSTERIOR, solve)


def _summary(beta: np.ndarray, cov: np.ndarray, s2: np.ndarray) -> dict[str, object]:
    return {
        "beta_hat": list(beta),
        "beta_var_diag": list(np.einsum("gii->gi", cov)),
        "beta_cov": list(cov.reshape(len(cov), -1)),
        "sigma2_mean": s2,
    }


def joint_posterior(pdf, p, diag, ratio, level, m) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and slopes, unit-noise covariance) under a prior on both, from centred statistics.

    At the group's mean covariates the intercept's prior pulls by ``ratio`` against n rows, which
    leaves shrink = n ratio / (n + ratio) of a row at the mean for the slopes: the centred block
    plus that rank-one term is solved for the slopes, and the intercept follows from them.
    """
    n, x_mean = pdf["n"].to_numpy(float), _stack(pdf["x_mean"], p)
    shrink = n * ratio / (n + ratio)
    block = _stack(pdf["xtx"], p, p) + np.diag(diag + JITTER) + np.einsum("g,gi,gj->gij", shrink, x_mean, x_mean)
    inv_w = _inverse(block)
    off = pdf["y_mean"].to_numpy(float) - level
    pull = _stack(pdf["xty"], p) - np.einsum("gij,gj->gi", _stack(pdf["xtx"], p, p), m)
    pull = pull + (shrink * (off - (x_mean * m).sum(1)))[:, None] * x_mean
    w = m + np.einsum("gij,gj->gi", inv_w, pull)
    share = n / (n + ratio)
    b = level + share * (off - (x_mean * w).sum(1))
    lever = share[:, None] * np.einsum("gij,gj->gi", inv_w, x_mean)
    cov = np.empty((len(pdf), p + 1, p + 1))
    cov[:, 0, 0] = 1.0 / (n + ratio) + share * (x_mean * lever).sum(1)
    cov[:, 0, 1:] = cov[:, 1:, 0] = -lever
    cov[:, 1:, 1:] = inv_w
    return np.column_stack([b, w]), cov


def group_posterior_with_prior(
    stats: DataFrame, keys: Sequence[str], p: int, penalty: float | Sequence[float],
    sigma2: float, tau_b: float, intercept_mean: str, slope_mean: str | None = None,
) -> DataFrame:
    """As :func:`group_posterior`, with a Normal(intercept_mean, tau_b) prior on the intercept."""
    if tau_b <= 0 or sigma2 <= 0:
        raise ValueError("tau_b and sigma2 must be positive")
    diag = _penalty(penalty, p)
    ratio = sigma2 / tau_b**2

    def solve(pdf):
        m = _stack(pdf[slope_mean], p) if slope_mean else np.zeros((len(pdf), p))
        beta, inv = joint_posterior(pdf, p, diag, ratio, pdf[intercept_mean].to_numpy(float), m)
        return _summary(beta, sigma2 * inv, np.full(len(pdf), float(sigma2)))

    return _solve_rows(stats, [*keys, "n"], _POSTERIOR, solve)


# -- shared noise --------------------------------------------------------------------------------


def residual_sums(
    stats: DataFrame, keys: Sequence[str], p: int, penalty: float | Sequence[float]
) -> DataFrame:
    """Penalised residual sum and degrees of freedom per group."""
    diag = _penalty(penalty, p)

    def solve(pdf):
        c = _stack(pdf["xty"], p)
        inv = _inverse(_stack(pdf["xtx"], p, p) + np.diag(diag + JITTER))
        sse = np.maximum(pdf["yty"] - np.einsum("gi,gij,gj->g", c, inv, c), 0.0)
        return {"sse": sse, "dof": np.maximum(pdf["n"] - 1, 0).astype("int64")}

    out = [T.StructField("sse", T.DoubleType()), T.StructField("dof", T.LongType())]
    return _solve_rows(stats, list(keys), out, solve)


def shared_variance(residuals: DataFrame, scale: float = 0.05) -> DataFrame:
    """One row: the noise variance all groups share, at the maximum of its collapsed posterior."""
    total = residuals.agg(F.sum("sse").alias("sse"), F.sum("dof").alias("dof"))
    n, s = F.col("dof"), F.col("sse")
    return total.select(
        "sse", "dof",
        (F.lit(2.0) * s / (n + F.sqrt(n * n + F.lit(4.0) * s / F.lit(scale * scale)))).alias("sigma2"),
    )


# -- trainers ------------------------------------------------------------------------------------


def train_groups(
    df: DataFrame, features: Sequence[str], group: str = "species_cluster", penalty: float | Sequence[float] = 1e-3,
    target: str = "rt", noise: str = "group", center: str | None = None, rotation: str | None = None,
    noise_scale: float = 0.05,
) -> tuple[DataFrame, dict[str, object]]:
    """Coefficient table per (group, comp_id) and the settings needed to score with it.

    ``noise='group'`` gives every group its own variance, ``noise='shared'`` one variance for all.
    """
    if group not in ("species_cluster", "species"):
        raise ValueError(f"unsupported group column {group!r}")
    if noise not in ("group", "shared"):
        raise ValueError(f"unknown noise model {noise!r}")
    if rotation is not None and center != "global":
        raise ValueError("a rotation needs center='global'")
    middle, turn = (None, None) if center is None else S.feature_transform(df, features, rotation)
    keys, p = [group, "comp_id"], len(features)
    stats = S.centred(S.group_sums(df, keys, features, target, middle), turn)
    sigma2 = None
    if noise == "shared":
        stats = stored(stats)
        sigma2 = shared_variance(residual_sums(stats, keys, p, penalty), noise_scale).first()["sigma2"]
    settings = {
        "features": list(features), "group": group, "center": middle, "rotation": turn, "sigma2": sigma2,
    }
    return group_posterior(stats, keys, p, penalty, sigma2), settings


def fit(df: DataFrame, features: Sequence[str], mode: str = "group_ridge", **options):
    """One entry for the model family; rejects combinations that have no meaning."""
    from peakloom.operators.pooling import train_partial_pool

    if mode in ("group_ridge", "shared_noise_ridge"):
        if "species_embedding" in options or "compound_effects" in options:
            raise ValueError(f"{mode} has no intercept hierarchy")
        noise = "group" if mode == "group_ridge" else "shared"
        return train_groups(df, features, noise=noise, **options)
    if mode == "partial_pool":
        if options.get("group", "species") != "species":
            raise ValueError("partial pooling works at species grain")
        options.pop("group", None)
        return train_partial_pool(df, features, **options)
    raise ValueError(f"unknown mode {mode!r}")


def poly2_penalties(features: Sequence[str], base: float, derived: float) -> list[float]:
    """Separate penalties for raw and degree-2 features."""
    return [derived if f.startswith("poly2_") else base for f in features]
