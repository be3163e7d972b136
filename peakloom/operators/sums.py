"""Sufficient statistics of per-group regressions: one mergeable row per group.

Rows are reduced before the shuffle, so a group holding a third of the data costs one partial
row per task like any other group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.values import feature_value

# Above this many features the products are accumulated as matrices inside the tasks instead of
# one SQL sum per product. Both ways give the same statistics.
SQL_FEATURES = 10
# Tasks a key's rows are spread over before their matrices are added up.
SALTS = 32

STAT_COLUMNS = ("n", "sum_x", "sum_y", "sum_yy", "sum_xx", "sum_xy")


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(p: int, value) -> Column:
    """Row-major P x P array from upper-triangle columns."""
    return F.array(*[value(min(i, j), max(i, j)) for i in range(p) for j in range(p)])


def group_sums(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str = "rt",
    center: Sequence[float] | None = None,
    target_center: float = 0.0,
    missing: str = "refuse",
) -> DataFrame:
    """n, sum x, sum y, sum y^2, sum x x', sum x y per key; the centres are subtracted first.

    A row whose target is null or not finite can't be learned from. ``missing='refuse'`` ends the
    job on the first one, ``'skip'`` leaves them out and counts them in ``n_left_out``; a group
    that has no others keeps its row with n = 0.
    """
    if missing not in ("refuse", "skip"):
        raise ValueError(f"missing must be 'refuse' or 'skip', not {missing!r}")
    keys, p = list(keys), len(features)
    shift = center if center is not None else [0.0] * p
    x = [feature_value(f, df.columns) - F.lit(float(c)) for f, c in zip(features, shift, strict=True)]
    y = F.col(target).cast("double")
    good = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf")))
    if missing == "refuse":
        stop = F.raise_error(F.lit(f"{target} is null or not finite; leave such rows out with missing='skip'")).cast("double")
        y, counted = F.when(good, y).otherwise(stop), []
    else:
        x, counted = [F.when(good, v) for v in x], [(~good).alias("_bad")]
        y = F.when(good, y)
    y = y - F.lit(float(target_center))
    if p > SQL_FEATURES:
        rows = df.select(*keys, *counted, y.alias("_y"), F.array(*x).alias("_x"))
        return _add_up(_matrices(rows, keys, p), keys, p)
    base = df.select(*keys, *counted, y.alias("_y"), *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = base.groupBy(*keys).agg(
        F.count("_y").alias("n"), *[F.count_if("_bad").alias("n_left_out") for _ in counted],
        total("_y").alias("sum_y"),
        total(F.col("_y") * F.col("_y")).alias("sum_yy"),
        *[total(f"_x{i}").alias(f"_s{i}") for i in range(p)],
        *[total(F.col(f"_x{i}") * F.col("_y")).alias(f"_t{i}") for i in range(p)],
        *[total(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}_{j}") for i, j in _upper(p)],
    )
    return sums.select(*keys, "n", *["n_left_out" for _ in counted], *_packed(p))


def _packed(p: int) -> list[Column]:
    return [
        F.array(*[f"_s{i}" for i in range(p)]).alias("sum_x"), F.col("sum_y"), F.col("sum_yy"),
        _square(p, lambda i, j: F.col(f"_q{i}_{j}")).alias("sum_xx"),
        F.array(*[f"_t{i}" for i in range(p)]).alias("sum_xy"),
    ]


_SUMMED = ("sum_x", "sum_xy", "sum_xx", "sum_y", "sum_yy")


def _stat_schema(df: DataFrame, keys: list[str], counts: Sequence[str]) -> T.StructType:
    vector = T.ArrayType(T.DoubleType())
    kinds = [*[(c, T.LongType()) for c in counts], *[(c, vector) for c in _SUMMED[:3]], *[(c, T.DoubleType()) for c in _SUMMED[3:]]]
    return T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, t) for c, t in kinds]])


def _runs(df: DataFrame, keys: list[str], schema: T.StructType, counts: Sequence[str], reduce) -> DataFrame:
    """One row per run of equal keys in sorted partitions: ``reduce`` turns the rows of a batch into
    (counts..., vectors..., scalars...), which are added until the key changes."""
    names = [*counts, *_SUMMED]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for pdf in batches:
            done = []
            for k, part in pdf.groupby(keys, sort=False, dropna=False):
                k = tuple(None if pd.isna(v) else v for v in k)
                values = reduce(part)
                if total is not None and k == key:
                    total = [a + b for a, b in zip(total, values)]
                else:
                    if total is not None:
                        done.append((*key, *total))
                    key, total = k, values
            if done:
                yield pd.DataFrame(done, columns=[*keys, *names])
        if total is not None:
            yield pd.DataFrame([(*key, *total)], columns=[*keys, *names])

    return df.mapInPandas(add, schema)


def _dealt(df: DataFrame, keys: list[str], salt: Column | None) -> DataFrame:
    at = [F.col(k) for k in keys] + ([salt] if salt is not None else [])
    return df.repartition(*at).sortWithinPartitions(*keys)


def _matrices(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Matrices per key and salt. The rows travel as they are, not as a matrix per batch and key."""
    counts = ["n", *["n_left_out" for c in rows.columns if c == "_bad"]]

    def reduce(part):
        if len(counts) > 1:
            bad = part["_bad"].to_numpy(bool)
            left, part = [int(bad.sum())], part[~bad]
        else:
            left = []
        x = np.stack(part["_x"].to_list()).astype(float) if len(part) else np.zeros((0, p))
        y = part["_y"].to_numpy(float)
        return [len(y), *left, x.sum(0), x.T @ y, (x.T @ x).ravel(), float(y.sum()), float(y @ y)]

    salt = F.pmod(F.xxhash64("_y", "_x", F.spark_partition_id()), F.lit(SALTS))
    return _runs(_dealt(rows, keys, salt), keys, _stat_schema(rows, keys, counts), counts, reduce)


def _add_up(parts: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Add statistics of equal keys, array by array; first per salt, then what is left of a key."""
    counts = [c for c in ("n", "n_left_out") if c in parts.columns]
    schema = _stat_schema(parts, keys, counts)
    vector = lambda part, c: np.sum(np.stack(part[c].to_list()).astype(float), axis=0)

    def reduce(part):
        return [*[int(part[c].sum()) for c in counts], *[vector(part, c) for c in _SUMMED[:3]], *[float(part[c].sum()) for c in _SUMMED[3:]]]

    narrow = parts.select(*[f.name for f in schema.fields])
    salt = F.pmod(F.xxhash64("sum_y", "sum_yy", F.spark_partition_id()), F.lit(SALTS))
    first = _runs(_dealt(narrow, keys, salt), keys, schema, counts, reduce)
    # at most SALTS rows of a key are left
    out = _runs(_dealt(first, keys, None), keys, schema, counts, reduce)
    return out.select(*keys, *counts, *[c for c in STAT_COLUMNS if c != "n"])


def _merge_partial(parts: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Add rows of equal keys element by element (combined before the shuffle)."""
    if p > SQL_FEATURES:
        return _add_up(parts, keys, p)
    counts = [c for c in ("n", "n_left_out") if c in parts.columns]
    item = lambda c, i: F.sum(F.get(F.col(c), F.lit(i)))
    merged = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("sum_y").alias("sum_y"), F.sum("sum_yy").alias("sum_yy"),
        *[item("sum_x", i).alias(f"_s{i}") for i in range(p)],
        *[item("sum_xy", i).alias(f"_t{i}") for i in range(p)],
        *[item("sum_xx", i * p + j).alias(f"_q{i}_{j}") for i, j in _upper(p)],
    )
    return merged.select(*keys, *counts, *_packed(p))


def roll_up(sums: DataFrame, keys: Sequence[str], features: int) -> DataFrame:
    """The same statistics at a coarser grain, from the finer rows instead of the data."""
    return _merge_partial(sums, list(keys), features)


def two_grains(
    df: DataFrame, fine: Sequence[str], coarse: Sequence[str], features: Sequence[str], target: str = "rt",
    center: Sequence[float] | None = None, target_center: float = 0.0, missing: str = "refuse",
) -> tuple[DataFrame, DataFrame]:
    """Statistics per fine key and per coarse key with a single pass over the rows."""
    by_fine = group_sums(df, fine, features, target, center, target_center, missing)
    return by_fine, roll_up(by_fine, coarse, len(features))


def global_means(df: DataFrame, features: Sequence[str], target: str = "rt") -> tuple[list[float], float]:
    """Means of the features and of the target over all rows: centres that keep digits in the sums."""
    row = df.agg(*[F.avg(feature_value(f, df.columns)).alias(f"_m{i}") for i, f in enumerate(features)], F.avg(F.col(target).cast("double")).alias("_y")).first()
    return [float(row[f"_m{i}"] or 0.0) for i in range(len(features))], float(row["_y"] or 0.0)


def centred(
    sums: DataFrame, rotation: Sequence[Sequence[float]] | None = None, center: Sequence[float] | None = None, target_center: float = 0.0
) -> DataFrame:
    """Replace raw sums by means and centred products: x_mean, y_mean, xtx, xty, yty.

    Groups without rows go. ``center`` and ``target_center`` are added to the means again, so that
    models come out in the units of the data; the products do not depend on them.
    """
    sums = sums.where("n > 0").drop("n_left_out")
    p = F.size("sum_x")
    n = F.col("n")
    x_mean = F.transform("sum_x", lambda v: v / n)
    y_mean = F.col("sum_y") / n
    out = sums.withColumns({"x_mean": x_mean, "y_mean": y_mean})
    out = out.withColumns(
        {
            "xtx": F.transform(
                "sum_xx",
                lambda v, k: v
                - n * F.get("x_mean", F.floor(k / p).cast("int")) * F.get("x_mean", k % p),
            ),
            "xty": F.transform("sum_xy", lambda v, k: v - n * F.get("x_mean", k) * F.col("y_mean")),
            "yty": F.greatest(F.col("sum_yy") - n * F.col("y_mean") * F.col("y_mean"), F.lit(0.0)),
        }
    ).drop("sum_x", "sum_y", "sum_yy", "sum_xx", "sum_xy")
    if center is not None:
        middle = F.array(*[F.lit(float(c)) for c in center])
        out = out.withColumn("x_mean", F.zip_with("x_mean", middle, lambda m, c: m + c))
    if target_center:
        out = out.withColumn("y_mean", F.col("y_mean") + F.lit(float(target_center)))
    return out if rotation is None else _rotate(out, np.asarray(rotation, float))


def _rotate(stats: DataFrame, r: np.ndarray) -> DataFrame:
    """Statistics of the rotated features x @ r."""
    p = r.shape[0]

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                xtx = np.stack(pdf["xtx"].to_list()).reshape(-1, p, p)
                pdf = pdf.assign(
                    x_mean=list(np.stack(pdf["x_mean"].to_list()) @ r),
                    xty=list(np.stack(pdf["xty"].to_list()) @ r),
                    xtx=list((r.T @ xtx @ r).reshape(len(pdf), -1)),
                )
            yield pdf

    return stats.mapInPandas(turn, stats.schema)


def feature_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: n, mean vector and (sample) covariance matrix of the features."""
    values = df.select(*[feature_value(f, df.columns).alias(f"_x{i}") for i, f in enumerate(features)])
    p = len(features)
    one = values.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(p)],
        *[F.covar_samp(f"_x{i}", f"_x{j}").alias(f"_c{i}_{j}") for i, j in _upper(p)],
    )
    return one.select(
        "n", F.array(*[f"_m{i}" for i in range(p)]).alias("mean"),
        _square(p, lambda i, j: F.col(f"_c{i}_{j}")).alias("covariance"),
    )


def feature_transform(
    df: DataFrame, features: Sequence[str], rotation: str | None = None
) -> tuple[list[float], list[list[float]] | None]:
    """Global centre and, for ``pca``, the rotation onto descending principal axes.

    Only a P vector and a P x P matrix reach the driver. Every axis is signed so that its largest
    loading is positive.
    """
    if rotation not in (None, "pca"):
        raise ValueError(f"unknown rotation {rotation!r}")
    row = feature_moments(df, features).first()
    if rotation is None:
        return list(row["mean"]), None
    cov = np.asarray(row["covariance"]).reshape(len(features), -1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    vectors = vectors[:, np.argsort(values)[::-1]]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return list(row["mean"]), vectors.tolist()


# -- run covariates ----------------------------------------------------------------------------


def run_means(
    df: DataFrame, run: Sequence[str], features: Sequence[str], owner: str = "species"
) -> DataFrame:
    """Mean covariates per run; ``n_owners`` above one means the run mixes species."""
    return df.groupBy(*run).agg(
        F.min(owner).alias(owner),
        F.when(F.min(owner) == F.max(owner), 1).otherwise(2).alias("n_owners"),
        *[F.avg(f).alias(f) for f in features],
    )


def require_single_owner(runs: DataFrame) -> DataFrame:
    bad = runs.where("n_owners > 1").take(5)
    if bad:
        raise ValueError(f"runs with several species: {bad}")
    return runs.drop("n_owners")


def run_metadata(
    df: DataFrame, run: str, covariates: Sequence[str] | None = None, prefix: str = "run_covariate_"
) -> DataFrame:
    """Unique rows (run, species, covariates); contradicting or negative runs are rejected."""
    names = list(covariates) if covariates is not None else [c for c in df.columns if c.startswith(prefix)]
    missing = [c for c in (run, "species", *names) if c not in df.columns]
    if missing or not names:
        raise ValueError(f"run metadata needs covariates; missing {missing}")
    values = ["species", *names]
    rows = df.groupBy(run).agg(
        *[F.min(c).alias(c) for c in values],
        F.greatest(*[(F.min(c) != F.max(c)).cast("int") for c in values]).alias("_differs"),
    )
    bad = rows.where((F.col("_differs") == 1) | (F.col(run) < 0)).take(5)
    if bad:
        raise ValueError(f"inconsistent runs: {bad}")
    return rows.drop("_differs")
