"""Apply coefficient tables to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.values import (
    design,
    diagonal_form,
    dot,
    feature_value,
    fixed_half_width,
    normal_quantile,
    quadratic_form,
    transform_vector,
)
from peakloom.operators.ridge import NOISE_SHAPE
from peakloom.plans.joins import lookup_join

# Models wider than this use array functions instead of unrolled products.
UNROLLED = 6


def _quadratic(x: str, flat: str, size: int) -> Column:
    if size <= UNROLLED:
        return quadratic_form(x, flat, size)
    row = lambda i: F.slice(F.col(flat), i * size + 1, size)
    return F.aggregate(
        F.transform(F.col(x), lambda v, i: v * dot(F.col(x), row(i))), F.lit(0.0), lambda acc, v: acc + v
    )


def score(
    rows: DataFrame, coefficients: DataFrame, features: Sequence[str], group: str = "species_cluster",
    target: str | None = "rt", level: float = 0.95, scale: float = 1.0,
    center: Sequence[float] | None = None, rotation: Sequence[Sequence[float]] | None = None,
    full_covariance: bool = True, require_seen: bool = False,
) -> DataFrame:
    """Predicted mean, sigma and interval of every row.

    Rows of a group without coefficients keep null predictions and ``seen = false``; with
    ``require_seen`` they are an error. Given a target, adds err, covered and width.
    """
    if not 0 < level < 1 or scale <= 0:
        raise ValueError("level must lie in (0, 1) and scale be positive")
    size = len(features) + 1
    wanted = ["beta_hat", "sigma2_mean", "beta_cov" if full_covariance else "beta_var_diag"]
    table = coefficients.select(group, "comp_id", F.col("n").alias("n_obs_train"), *wanted)
    joined = lookup_join(rows, table, [group, "comp_id"], "left")
    if require_seen:
        missing = joined.where("beta_hat IS NULL").select(group, "comp_id").distinct().take(10)
        if missing:
            raise ValueError(f"groups without coefficients: {[tuple(r) for r in missing]}")
    x = design(features, rows.columns)
    if center is not None:
        x = transform_vector(x, center, rotation)
    out = joined.withColumn("_x", F.concat(F.array(F.lit(1.0)), x))
    spread = _quadratic("_x", "beta_cov", size) if full_covariance else diagonal_form("_x", "beta_var_diag")
    sigma = F.sqrt(F.greatest("sigma2_mean", F.lit(1e-12)) + F.greatest(spread, F.lit(0.0))) * F.lit(scale)
    mean = sum((F.get("beta_hat", F.lit(i)) * F.get("_x", F.lit(i)) for i in range(1, size)), F.get("beta_hat", F.lit(0)))
    if size > UNROLLED:
        mean = dot("beta_hat", "_x")
    out = out.withColumns(
        {"seen": F.col("beta_hat").isNotNull(), "pred_mean": mean, "pred_std": F.when(F.col("beta_hat").isNotNull(), sigma)}
    ).drop("_x", *wanted)
    return out if target is None else with_errors(out, target, level)


def with_errors(scored: DataFrame, target: str, level: float = 0.95) -> DataFrame:
    """err, covered and width of Normal intervals."""
    q = normal_quantile(level)
    err = F.col("pred_mean") - F.col(target)
    return scored.withColumns(
        {
            "err": err,
            "covered": F.abs(err) <= F.lit(q) * F.col("pred_std"),
            "width": F.lit(2 * q) * F.col("pred_std"),
        }
    )


def _two_level(rows: DataFrame, fine: DataFrame, coarse: DataFrame, group: str, compound: str) -> DataFrame:
    """Coefficients of (group, compound), else of the compound alone; flags which one was used."""
    values = [c for c in fine.columns if c not in (group, compound)]
    pack = F.struct(*values)
    joined = lookup_join(rows, fine.select(group, compound, pack.alias("_f")), [group, compound], "left")
    joined = lookup_join(joined, coarse.select(compound, pack.alias("_c")), [compound], "left")
    return joined.withColumns(
        {
            "used_fallback": F.col("_f").isNull() & F.col("_c").isNotNull(),
            "matched": F.col("_f").isNotNull() | F.col("_c").isNotNull(),
            "_m": F.coalesce("_f", "_c"),
        }
    ).drop("_f", "_c")


def _linear(features: Sequence[str]) -> Column:
    acc = F.col("_m.intercept")
    for i, f in enumerate(features):
        acc = acc + F.get("_m.coef", F.lit(i)) * feature_value(f)
    return acc


def predict_two_level(
    rows: DataFrame, fine: DataFrame, coarse: DataFrame, features: Sequence[str],
    group: str = "supercategory", compound: str = "comp_id",
) -> DataFrame:
    """pred_mean, pred_std and used_fallback from the two-grain model; unmatched rows get nulls."""
    joined = _two_level(rows, fine, coarse, group, compound)
    return joined.withColumns({"pred_mean": _linear(features), "pred_std": F.col("_m.sigma")}).drop("_m")


def predict_posterior(
    rows: DataFrame, fine: DataFrame, coarse: DataFrame, features: Sequence[str],
    group: str = "supercategory", compound: str = "comp_id", intercept_uncertainty: bool = True,
) -> DataFrame:
    """Student-t predictive: mean, standard deviation and degrees of freedom."""
    joined = _two_level(rows, fine, coarse, group, compound)
    inflation = F.lit(1.0)
    for i, f in enumerate(features):
        gap = feature_value(f) - F.get("_m.x_mean", F.lit(i))
        inflation = inflation + gap * gap * F.get("_m.v_diag", F.lit(i))
    if intercept_uncertainty:
        inflation = inflation + F.lit(1.0) / F.greatest(F.col("_m.n"), F.lit(1))
    return joined.withColumns(
        {
            "pred_mean": _linear(features),
            "pred_std": F.sqrt(F.greatest(F.col("_m.sigma2_mean") * inflation, F.lit(0.0))),
            "pred_df": F.col("_m.n") + F.lit(2 * NOISE_SHAPE),
        }
    ).drop("_m")


def score_bundle(
    rows: DataFrame, models: DataFrame, features: Sequence[str], target: str = "rt",
    multiplier: float = 4.0, minimum: float = 0.001,
) -> DataFrame:
    """Score fixed-window models; a feature absent from a model counts as zero.

    Rows without a supercategory or without a model keep null predictions.
    """
    joined = lookup_join(rows, models, ["supercategory", "comp_id"], "left")
    mean = F.col("b")
    for f in features:
        mean = mean + F.coalesce(F.try_element_at("coefs", F.lit(f)), F.lit(0.0)) * feature_value(f, rows.columns)
    half = fixed_half_width("window", multiplier, minimum)
    err = mean - F.col(target)
    return joined.withColumns(
        {
            "no_supercategory": F.col("supercategory").isNull(),
            "no_model": F.col("supercategory").isNotNull() & F.col("b").isNull(),
            "seen": F.col("b").isNotNull(), "pred_mean": mean,
            "pred_std": F.lit(None).cast("double"),
            "err": err, "covered": F.abs(err) <= half, "width": F.lit(2.0) * half,
        }
    ).drop("b", "window", "coefs")


def score_backoff(
    rows: DataFrame, species: DataFrame, compounds: DataFrame, features: Sequence[str], t0: float, clusters: DataFrame | None = None
) -> DataFrame:
    """Mean for unseen groups: hierarchy effects in place of group coefficients.

    ``species`` holds (species, mu, slopes); ``compounds`` holds (comp_id, alpha, alpha_prior):
    alpha is null for compounds that were not trained, whose prior mean stands in. A species that was
    not trained takes the effect of its cluster from ``clusters`` (species_cluster, mu, slopes);
    what is unknown there as well contributes zero. ``effect_of`` names the level that was used.
    """
    joined = lookup_join(rows, species.select("species", F.struct("mu", "slopes").alias("_s")), ["species"], "left")
    none = F.lit(None).cast(joined.schema["_s"].dataType)
    if clusters is None:
        joined = joined.withColumn("_q", none)
    else:
        joined = lookup_join(joined, clusters.select("species_cluster", F.struct("mu", "slopes").alias("_q")), ["species_cluster"], "left")
    joined = lookup_join(joined, compounds.select("comp_id", "alpha", "alpha_prior"), ["comp_id"], "left").withColumn("_e", F.coalesce("_s", "_q"))
    mean = F.lit(float(t0)) + F.coalesce("_e.mu", F.lit(0.0)) + F.coalesce("alpha", "alpha_prior", F.lit(0.0))
    for i, f in enumerate(features):
        mean = mean + F.coalesce(F.get("_e.slopes", F.lit(i)), F.lit(0.0)) * feature_value(f, rows.columns)
    level = F.when(F.col("_s").isNotNull(), "species").when(F.col("_q").isNotNull(), "cluster").otherwise("none")
    return joined.withColumns({"pred_mean": mean, "effect_of": level}).drop("_s", "_q", "_e", "alpha", "alpha_prior")
