"""Candidate compounds per peak: mass window, retention window, features, slots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.values import (
    ION_INDICATORS,
    ION_SHIFTS,
    hash_text,
    ion_indicators,
    log_intensity,
    log_rt_uncertainty,
    mass_tolerance,
    ppm_error,
    rt_z,
)
from peakloom.plans.joins import GROWING_BYTES, grown_join, lookup_join, unique
from peakloom.plans.ordered import exact_percentiles, ordered_scan

# Candidate features in model order.
FEATURES: tuple[str, ...] = (
    "mass_err_ppm", "rt_z", "log_intensity", "log_rt_uncertainty", "has_isotope", "isotope_score",
    "n_adducts", "rt_cluster_size", "n_correlated", *ION_INDICATORS.values(),
)
CONTEXT: tuple[str, ...] = ("has_isotope", "isotope_score", "n_adducts", "rt_cluster_size", "n_correlated")

_IONS = list(ION_SHIFTS)
# Planned size up to which ions are broadcast; every compound becomes a row per ion and touched bin.
_ION_BYTES = GROWING_BYTES // (2 * len(_IONS))
# Masses below this share one bin.
_MASS_FLOOR = 1e-3


def ion_library(library: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(compound_id, neutral, ion_idx, theoretical, ``carry``): every ion of every compound with a valid mass."""
    ions = F.array(*[F.struct(F.lit(i).alias("ion_idx"), F.lit(s).alias("shift")) for i, s in enumerate(ION_SHIFTS.values())])
    return library.select("compound_id", "mass", *carry, F.explode(ions).alias("i")).select(
        "compound_id", F.col("mass").alias("neutral"), "i.ion_idx", (F.col("mass") + F.col("i.shift")).alias("theoretical"), *carry
    ).where("theoretical >= 0")


def _ion_name(idx: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in _IONS]), idx).alias("ion")


def _closest_ion(ppm: float) -> Column:
    """Whether no other ion of the row's compound matches its peak and is closer, or as close and
    earlier in ion order."""
    e = F.abs(F.col("mass") - F.col("theoretical"))
    beaten = F.lit(False)
    for i, shift in enumerate(ION_SHIFTS.values()):
        other = F.col("neutral") + F.lit(shift)
        d = F.abs(F.col("mass") - other)
        wins = (d < e) | ((d == e) & (F.lit(i) < F.col("ion_idx")))
        beaten = beaten | ((F.lit(i) != F.col("ion_idx")) & (other >= 0) & (d <= mass_tolerance(other, ppm)) & wins)
    return ~beaten


def _peak_first(peaks: DataFrame) -> list[str]:
    return ["peak_id", *[c for c in peaks.columns if c != "peak_id"]]


def _log_bin(mass: Column, width: float) -> Column:
    return F.floor(F.log(F.greatest(mass, F.lit(_MASS_FLOOR))) / F.lit(width))


def mass_matches(peaks: DataFrame, library: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Peak columns plus (compound_id, ion, theoretical): the closest matching ion per compound.

    Bins are a fixed ratio wide, so a tolerance in ppm spans the same few bins at every mass. A
    peak has one bin, an ion is entered into every bin its window touches, and the exact
    comparison follows the equi-join. A row knows the other ions of its compound, so the closest one
    is found without gathering the rows of a pair; only repeated ids have to be.
    """
    width = 4.0 * ppm * 1e-6
    tol = mass_tolerance("theoretical", ppm)
    pad = tol * F.lit(1e-6) + F.lit(1e-12)
    ions = ion_library(library).withColumn(
        "_bin",
        F.explode(F.sequence(_log_bin(F.col("theoretical") - tol - pad, width), _log_bin(F.col("theoretical") + tol + pad, width))),
    )
    binned = peaks.withColumn("_bin", _log_bin(F.col("mass"), width))
    near = lookup_join(binned, ions, ["_bin"], "inner", max_bytes=_ION_BYTES).drop("_bin")
    error = F.abs(F.col("mass") - F.col("theoretical"))
    hits = near.where((error <= tol) & _closest_ion(ppm))
    if unique(peaks, "peak_id") and unique(library, "compound_id"):
        return hits.select(*_peak_first(peaks), "compound_id", _ion_name(F.col("ion_idx")), "theoretical")
    # ions of one compound compete; the first one in ion order wins a tie
    best = F.min(F.struct(error.alias("e"), "ion_idx", "theoretical")).alias("_b")
    peak = F.struct(*[F.col(c) for c in peaks.columns if c != "peak_id"])
    out = hits.groupBy("peak_id", "compound_id").agg(best, F.any_value(peak).alias("_p"))
    return out.select(
        "peak_id", *[F.col(f"_p.{c}").alias(c) for c in peaks.columns if c != "peak_id"], "compound_id",
        _ion_name(F.col("_b.ion_idx")),
        F.col("_b.theoretical").alias("theoretical"),
    )


# Width of the time bins of window_matches, in minutes; windows up to this width touch two bins.
RT_BIN = 0.5


def window_matches(
    peaks: DataFrame, library: DataFrame, rt_pred: DataFrame, ppm: float = 10.0, k: float = 1.5, floor: float = 0.05, rt_bin: float = RT_BIN,
    carry: Sequence[str] = (),
) -> DataFrame:
    """What :func:`rt_matches` keeps of :func:`mass_matches`, from one join on mass bin and time bin.

    The time window belongs to the compound, not to the ion, so it may be applied before the closest
    ion is chosen. Predictions carry the ions of their compound and are entered into every cell their
    window touches, a peak has one cell. The closest ion is chosen as in :func:`mass_matches`. ``carry``
    names columns of a library without repeated ids that come along.
    """
    width = 4.0 * ppm * 1e-6
    tol = mass_tolerance("theoretical", ppm)
    pad = tol * F.lit(1e-6) + F.lit(1e-12)
    half = F.lit(k) * F.greatest(F.col("rt_std"), F.lit(floor)) + F.lit(1e-9)
    rt_bins = F.sequence(F.floor((F.col("rt_mean") - half) / rt_bin), F.floor((F.col("rt_mean") + half) / rt_bin))
    mass_bins = F.sequence(_log_bin(F.col("theoretical") - tol - pad, width), _log_bin(F.col("theoretical") + tol + pad, width))
    timed = rt_pred.where("rt_mean IS NOT NULL AND rt_std IS NOT NULL").select("species", "compound_id", "rt_mean", "rt_std", F.explode(rt_bins).alias("_rb"))
    targets = lookup_join(timed, ion_library(library, carry).withColumn("_mb", F.explode(mass_bins)), ["compound_id"], "inner", max_bytes=_ION_BYTES)
    binned = peaks.withColumns({"_mb": _log_bin(F.col("mass"), width), "_rb": F.floor(F.col("rt") / rt_bin)})
    near = lookup_join(binned, targets, ["species", "_mb", "_rb"], "inner", max_bytes=_ION_BYTES)
    error = F.abs(F.col("mass") - F.col("theoretical"))
    hits = near.withColumn("rt_z", rt_z("rt", "rt_mean", "rt_std", floor)).where((error <= tol) & (F.abs("rt_z") <= k) & _closest_ion(ppm))
    rest = [c for c in peaks.columns if c != "peak_id"]
    if unique(peaks, "peak_id") and unique(library, "compound_id") and unique(rt_pred, "species", "compound_id"):
        return hits.select(*_peak_first(peaks), "compound_id", _ion_name(F.col("ion_idx")), "theoretical", "rt_mean", "rt_std", "rt_z", *carry)
    best = F.min(F.struct(error.alias("e"), "ion_idx", "theoretical")).alias("_b")
    out = hits.groupBy("peak_id", "compound_id").agg(best, F.any_value(F.struct(*rest, "rt_mean", "rt_std", "rt_z", *carry)).alias("_p"))
    return out.select(
        "peak_id", *[F.col(f"_p.{c}").alias(c) for c in rest], "compound_id",
        _ion_name(F.col("_b.ion_idx")), F.col("_b.theoretical").alias("theoretical"),
        *[F.col(f"_p.{c}").alias(c) for c in ("rt_mean", "rt_std", "rt_z", *carry)],
    )


def rt_matches(matches: DataFrame, rt_pred: DataFrame, k: float = 1.5, floor: float = 0.05) -> DataFrame:
    """Keep matches within ``k`` predicted standard deviations; adds rt_mean, rt_std, rt_z."""
    joined = lookup_join(matches, rt_pred, ["species", "compound_id"], "inner", max_bytes=GROWING_BYTES)
    return joined.withColumn("rt_z", rt_z("rt", "rt_mean", "rt_std", floor)).where(F.abs("rt_z") <= k)


def with_features(matches: DataFrame, context: DataFrame) -> DataFrame:
    """The 16 candidate features; both inputs are keyed by peak."""
    joined = grown_join(matches, context.select("peak_id", *CONTEXT), ["peak_id"])
    keep = [c for c in matches.columns if c not in ("ion", "theoretical", "rt_z", "rt_mean", "rt_std")]
    return joined.select(
        *keep, "ion",
        ppm_error("mass", "theoretical").alias("mass_err_ppm"), "rt_z",
        log_intensity("intensity").alias("log_intensity"), log_rt_uncertainty("rt_std").alias("log_rt_uncertainty"),
        *CONTEXT, *ion_indicators("ion"),
    )


def generate(
    peaks: DataFrame, library: DataFrame, rt_pred: DataFrame, context: DataFrame, ppm: float = 10.0,
    k: float = 1.5, floor: float = 0.05,
) -> DataFrame:
    """Long candidate table; decoys are flagged, training uses the rows without the flag."""
    library = library.withColumn("is_decoy", F.coalesce("is_decoy", F.lit(False)))
    if unique(library, "compound_id"):
        flagged = window_matches(peaks, library, rt_pred, ppm, k, floor, carry=["is_decoy"])
    else:
        # every row of a repeated compound gives its own candidate
        found = window_matches(peaks, library, rt_pred, ppm, k, floor)
        flagged = lookup_join(found, library.select("compound_id", "is_decoy"), ["compound_id"], "left", max_bytes=GROWING_BYTES)
    out = with_features(flagged, context)
    return out.select("compound_id", *[c for c in out.columns if c not in ("compound_id", "is_decoy")], "is_decoy")


def training_rows(candidates: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(peak_id, species, compound_id, features) of the candidates the weights may learn from: no decoys."""
    return candidates.where(~F.col("is_decoy")).select("peak_id", "species", "compound_id", *features)


def number_slots(candidates: DataFrame, peaks: DataFrame) -> DataFrame:
    """Slots 1..K in compound order after the null slot 0, which every peak has.

    ``label`` is the slot of the true compound: 0 for noise, -1 when it is not among the
    candidates.
    """
    order = Window.partitionBy("peak_id").orderBy("compound_id")
    numbered = candidates.withColumn("slot", F.row_number().over(order))
    # the null slot carries the peak's own columns, so the label needs no second join
    null = peaks.select(
        *[F.col(c) for c in peaks.columns if c in numbered.columns], F.lit(0).alias("slot")
    )
    rows = numbered.unionByName(null, allowMissingColumns=True)
    per_peak = Window.partitionBy("peak_id")
    hit = F.max(F.when(F.col("compound_id") == F.col("true_compound"), F.col("slot"))).over(per_peak)
    return rows.withColumn("label", F.when(F.col("true_compound").isNull(), 0).otherwise(F.coalesce(hit, F.lit(-1))))


def feature_scaler(candidates: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population sd per feature over training candidates; a zero sd becomes one."""
    row = candidates.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    ).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def standardise(candidates: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return candidates.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in scaler.items()})


def seed_labels(slots: DataFrame, fraction: float, seed: int) -> DataFrame:
    """(peak_id, label) of a seeded share of the usable peaks, at least one.

    The cut is made on a distributed rank: a large share never passes through one task.
    """
    usable = slots.where("slot = 0 AND label >= 0").select(
        "peak_id", "label", hash_text(["peak_id"], seed).alias("_h"), F.lit(1).cast("long").alias("_one")
    )
    take = max(1, int(usable.count() * fraction))
    ranked = ordered_scan(usable, [], ["_h", "peak_id"], sums={"_rank": "_one"})
    return ranked.where(F.col("_rank") <= take).select("peak_id", "label")


def rt_predictions(coefficients: DataFrame, runs: DataFrame, features: Sequence[str]) -> DataFrame:
    """(species, compound_id, rt_mean, rt_std) at each species' lowest-numbered run.

    ``coefficients`` holds a row per (species, compound_id); joining its own species gives the
    whole species x compound grid without forming a product.
    """
    first = runs.groupBy("species").agg(F.min(F.struct("run", *features)).alias("_r")).select(
        "species", *[F.col(f"_r.{f}").alias(f) for f in features]
    )
    joined = lookup_join(coefficients, first, ["species"], "inner")
    x = F.array(F.lit(1.0), *[F.col(f) for f in features])
    mean, spread = F.get("beta_hat", F.lit(0)), F.get("beta_var_diag", F.lit(0))
    for i, f in enumerate(features, start=1):
        mean = mean + F.get("beta_hat", F.lit(i)) * F.col(f)
    size = len(features) + 1
    from peakloom.operators.scoring import _quadratic

    joined = joined.withColumn("_x", x)
    return joined.select(
        "species", "compound_id", mean.alias("rt_mean"),
        F.sqrt(F.greatest(F.col("sigma2_mean") + F.greatest(_quadratic("_x", "beta_cov", size), F.lit(0.0)), F.lit(0.0))).alias("rt_std"),
    )


def complexity(peaks: DataFrame, library: DataFrame, mass_window: float, sigmas: float = 2.0) -> DataFrame:
    """(peak_id, n_candidates) within an absolute mass window and ``sigmas`` predicted sd.

    ``library`` holds (compound_id, mass, rt_mean, rt_std); both windows are strict.
    """
    width = 2.0 * mass_window
    lib = library.select(
        "compound_id", F.col("mass").alias("theoretical"), "rt_mean", "rt_std",
        F.explode(F.sequence(F.floor((F.col("mass") - mass_window - 1e-9) / width), F.floor((F.col("mass") + mass_window + 1e-9) / width))).alias("_bin"),
    )
    binned = peaks.select("peak_id", "mass", "rt", F.floor(F.col("mass") / width).alias("_bin"))
    hits = lookup_join(binned, lib, ["_bin"], "inner", max_bytes=GROWING_BYTES).where(
        (F.abs(F.col("theoretical") - F.col("mass")) < mass_window)
        & (F.abs(F.col("rt") - F.col("rt_mean")) < F.lit(sigmas) * F.col("rt_std"))
    )
    counts = hits.groupBy("peak_id").agg(F.count(F.lit(1)).alias("_n"))
    return grown_join(peaks.select("peak_id"), counts, ["peak_id"], "left").select(
        "peak_id", F.coalesce("_n", F.lit(0).cast("long")).alias("n_candidates")
    )


def complexity_stats(counts: DataFrame) -> DataFrame:
    """One row: mean, median, extremes and how many peaks have 0, 1, 2+, 5+ and 10+ candidates."""
    n = F.col("n_candidates")
    sizes = counts.groupBy("n_candidates").agg(F.count(F.lit(1)).alias("w"))
    stats = sizes.agg(
        (F.sum(n * F.col("w")) / F.sum("w")).alias("mean_candidates"),
        F.min(n).alias("min_candidates"), F.max(n).alias("max_candidates"),
        *[
            F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0).cast("long")).alias(name)
            for name, test in (
                ("peaks_with_0", n == 0), ("peaks_with_1", n == 1), ("peaks_with_2plus", n >= 2),
                ("peaks_with_5plus", n >= 5), ("peaks_with_10plus", n >= 10),
            )
        ],
    )
    median = exact_percentiles(sizes.withColumn("v", n.cast("double")), [], "v", {"median_candidates": 0.5}, weight="w")
    one = F.lit(1).alias("_k")
    return stats.select("*", one).join(median.select("*", one), ["_k"]).drop("_k")
