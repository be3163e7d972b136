"""Scalar and array expressions of the peak and model tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named ion forms and their mass shifts, in matching order.
ION_SHIFTS: dict[str, float] = {
    "M+H": 0.0,
    "M+13C": 1.00335,
    "M+Na": 21.9819,
    "M+K": 37.9559,
    "M+NH4": 18.0338,
    "M-H2O+H": -18.0106,
    "M-CO2+H": -43.9898,
}
# Indicator column of each ion form.
ION_INDICATORS: dict[str, str] = {
    "M+H": "is_MH",
    "M+13C": "is_M13C",
    "M+Na": "is_MNa",
    "M+K": "is_MK",
    "M+NH4": "is_MNH4",
    "M-H2O+H": "is_MH2O_loss",
    "M-CO2+H": "is_MCO2_loss",
}
# Upper edges of the training-support bins.
SUPPORT_EDGES: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- keys ------------------------------------------------------------------------------------


def packed_key(group: Column | str, compound: Column | str) -> Column:
    """One BIGINT for (group, compound); ids must be non-negative and below 2**31 / 2**32."""
    return F.shiftleft(_col(group).cast("long"), 32) + _col(compound).cast("long")


def unpack_group(key: Column | str) -> Column:
    return F.shiftright(_col(key), 32)


def unpack_compound(key: Column | str) -> Column:
    return _col(key).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def leading_integer(label: Column | str) -> Column:
    """Leading integer of a group label, null when there is none."""
    return F.regexp_extract(_col(label), r"^\s*(\d+)", 1).try_cast("long")


def library_number(path: Column | str) -> Column:
    """The number after ``lib`` in a file name."""
    return F.regexp_extract(_col(path), r"lib(\d+)", 1).try_cast("long")


def hash_text(keys: Sequence[Column | str], seed: int) -> Column:
    """Seeded hex digest of integer keys: the same in any engine with MD5."""
    parts = [F.coalesce(_col(k).cast("string"), F.lit("~")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_fraction(keys: Sequence[Column | str], seed: int) -> Column:
    """Uniform number in [0, 1) that depends only on the keys and the seed."""
    bits = F.conv(F.substring(hash_text(keys, seed), 1, 12), 16, 10).cast("long")
    return bits / F.lit(float(1 << 48))


# -- bins and labels ---------------------------------------------------------------------------


def support_labels(edges: Sequence[int] = SUPPORT_EDGES) -> list[str]:
    """Labels of right-closed bins over positive counts."""
    edges = sorted(edges)
    labels = [f"<= {edges[0]}"]
    labels += [f"{lo + 1}-{hi}" for lo, hi in zip(edges, edges[1:])]
    return [*labels, f"> {edges[-1]}"]


def support_bin_index(n: Column | str, edges: Sequence[int] = SUPPORT_EDGES) -> Column:
    """Index of the first edge that is at least ``n``."""
    edges = sorted(edges)
    expr = F.when(_col(n) <= edges[0], 0)
    for i, edge in enumerate(edges[1:], start=1):
        expr = expr.when(_col(n) <= edge, i)
    return expr.when(_col(n).isNotNull(), len(edges))


def support_bin(n: Column | str, edges: Sequence[int] = SUPPORT_EDGES) -> Column:
    labels = F.array(*[F.lit(x) for x in support_labels(edges)])
    return F.get(labels, support_bin_index(n, edges))


def matrix_category(label: Column | str) -> Column:
    """Coarse sample category from a group label."""
    text = F.lower(_col(label))
    return (
        F.when(text.contains("blood"), "blood")
        .when(text.contains("urine"), "urine")
        .when(text.contains("cells") | text.contains("plants"), "cells")
        .otherwise("other")
    )


# -- peaks -----------------------------------------------------------------------------------


def ppm_error(mass: Column | str, theoretical: Column | str) -> Column:
    return (_col(mass) - _col(theoretical)) / _col(theoretical) * F.lit(1e6)


def mass_tolerance(theoretical: Column | str, ppm: float) -> Column:
    return F.lit(float(ppm)) * F.greatest(_col(theoretical), F.lit(1e-6)) * F.lit(1e-6)


def rt_z(rt: Column | str, mean: Column | str, std: Column | str, floor: float = 0.05) -> Column:
    return (_col(rt) - _col(mean)) / F.greatest(_col(std), F.lit(float(floor)))


def log_intensity(intensity: Column | str) -> Column:
    return F.log1p(_col(intensity))


def log_rt_uncertainty(std: Column | str) -> Column:
    return F.log(_col(std) + F.lit(1e-6))


def ion_indicators(ion: Column | str) -> list[Column]:
    return [F.when(_col(ion) == k, 1.0).otherwise(0.0).alias(v) for k, v in ION_INDICATORS.items()]


def isotope_score(ratio: Column | str) -> Column:
    """Grade of an isotope partner by its relative intensity; null ratio means no partner."""
    r = _col(ratio)
    return (
        F.when(r.isNull(), 0.0)
        .when(r.between(0.11, 0.33), 1.0)
        .when(r.between(0.05, 0.55), 0.7)
        .otherwise(0.3)
    )


# -- features --------------------------------------------------------------------------------


def clean(x: Column | str) -> Column:
    """Null and NaN become zero."""
    return F.coalesce(F.nanvl(_col(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def is_anchor(name: str) -> bool:
    return name.startswith(("IS", "RS"))


def quadratic_names(features: Sequence[str]) -> list[str]:
    """Names of the degree-2 terms of the anchor features: squares, then pairs."""
    anchors = [f for f in features if is_anchor(f)]
    pairs = [(a, b) for i, a in enumerate(anchors) for b in anchors[i + 1 :]]
    return [f"poly2_sq({a})" for a in anchors] + [f"poly2_int({a},{b})" for a, b in pairs]


# How derived feature names are written.
_SQUARE = re.compile(r"poly2_sq\((?P<a>[^,()]+)\)")
_PRODUCT = re.compile(r"poly2_int\((?P<a>[^,()]+),(?P<b>[^,()]+)\)")


def raw_inputs(feature: str) -> tuple[str, ...]:
    """Raw columns a (possibly derived) feature reads."""
    if m := _SQUARE.fullmatch(feature):
        return (m["a"],)
    if m := _PRODUCT.fullmatch(feature):
        return (m["a"], m["b"])
    return (feature,)


def feature_value(feature: str, columns: Sequence[str] | None = None) -> Column:
    """Expression of a raw or derived feature, nulls as zero."""
    inputs = raw_inputs(feature)
    if columns is not None and (missing := [c for c in inputs if c not in columns]):
        raise ValueError(f"feature {feature} needs missing columns {missing}")
    if _SQUARE.fullmatch(feature):
        return clean(inputs[0]) * clean(inputs[0])
    if len(inputs) == 2:
        return clean(inputs[0]) * clean(inputs[1])
    return clean(inputs[0])


def design(features: Sequence[str], columns: Sequence[str] | None = None) -> Column:
    """Feature vector in design order."""
    return F.array(*[feature_value(f, columns) for f in features])


def transform_vector(
    x: Column | str, center: Sequence[float], rotation: Sequence[Sequence[float]] | None = None
) -> Column:
    """``(x - center) @ rotation`` on an array column."""
    p = len(center)
    shifted = [F.get(_col(x), F.lit(i)) - F.lit(float(center[i])) for i in range(p)]
    if rotation is None:
        return F.array(*shifted)
    cols = []
    for j in range(p):
        acc = F.lit(0.0)
        for i in range(p):
            acc = acc + shifted[i] * F.lit(float(rotation[i][j]))
        cols.append(acc)
    return F.array(*cols)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda u, v: u * v), F.lit(0.0), lambda acc, u: acc + u
    )


def diagonal_form(x: Column | str, variances: Column | str) -> Column:
    """Sum of x_j squared times variance_j."""
    return F.aggregate(
        F.zip_with(_col(x), _col(variances), lambda u, v: u * u * v), F.lit(0.0), lambda acc, u: acc + u
    )


def quadratic_form(x: Column | str, flat: Column | str, size: int) -> Column:
    """x' M x for a matrix stored row by row in an array; stays in the JVM for small designs."""
    acc = F.lit(0.0)
    for i in range(size):
        for j in range(size):
            acc = acc + F.get(_col(x), F.lit(i)) * F.get(_col(x), F.lit(j)) * F.get(
                _col(flat), F.lit(i * size + j)
            )
    return acc


# -- intervals -------------------------------------------------------------------------------


def normal_quantile(level: float) -> float:
    """Two-sided Normal multiplier of a central interval."""
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def predictive_sigma(sigma2: Column | str, variance: Column | str, scale: float = 1.0) -> Column:
    return F.sqrt(F.greatest(_col(sigma2) + _col(variance), F.lit(0.0))) * F.lit(float(scale))


def fixed_half_width(window: Column | str, multiplier: float = 4.0, minimum: float = 0.001) -> Column:
    return F.lit(float(multiplier)) * F.greatest(_col(window), F.lit(float(minimum)))


# -- presence priors and probabilities ---------------------------------------------------------


def beta_mean(alpha: Column | str, beta: Column | str) -> Column:
    return _col(alpha) / (_col(alpha) + _col(beta))


def beta_variance(alpha: Column | str, beta: Column | str) -> Column:
    s = _col(alpha) + _col(beta)
    return _col(alpha) * _col(beta) / (s * s * (s + 1))


def log_prior(alpha: Column | str, beta: Column | str) -> Column:
    return F.log(F.least(F.greatest(beta_mean(alpha, beta), F.lit(1e-12)), F.lit(1.0)))


def entropy_term(p: Column | str) -> Column:
    """-p log p with p kept inside [1e-12, 1]."""
    q = F.least(F.greatest(_col(p), F.lit(1e-12)), F.lit(1.0))
    return -q * F.log(q)


def nested_value(column: Column | str, path: Sequence[str], default: object = None) -> Column:
    """A value inside a nested column, ``default`` when any level is absent."""
    value = _col(column)
    for step in path:
        value = value.getField(step)
    return value if default is None else F.coalesce(value, F.lit(default))


def case_map(column: Column | str, values: Mapping[object, object]) -> Column:
    """Look a value up among a few fixed ones."""
    expr = F.lit(None)
    for key, value in values.items():
        expr = F.when(_col(column) == F.lit(key), F.lit(value)).otherwise(expr)
    return expr
