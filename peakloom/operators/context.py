"""Chemical context of a peak: isotope and adduct partners, co-elution, signal to noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.values import ION_SHIFTS, isotope_score
from peakloom.plans.durable import settled, stored
from peakloom.plans.joins import GROWING_BYTES, grown_join, hot_keys, lookup_join
from peakloom.plans.ordered import (
    counts_within,
    counts_within_box,
    counts_of_probes,
    exact_percentiles,
    nearest_within_box,
)

# Windows of the partner search and of the co-elution counts.
MASS_WINDOW = 0.01
RT_WINDOW = 0.1
CORRELATION_RT = 0.5
CORRELATION_LOG = 1.0
NOISE_FRACTION = 0.1

# A cell with more distinct points than this is searched in order instead of pairwise.
CELL_POINTS = 64

# Written size of the crowded cells up to which they are broadcast, some ten bytes a cell.
CROWDED_BYTES = 2 << 20

_CELL = ["species", "_cm", "_cr"]


def _probe_shifts() -> list[tuple[int, float]]:
    """(probe number, signed shift): every non-zero ion shift in both directions."""
    shifts = [s for s in ION_SHIFTS.values() if s != 0.0]
    return list(enumerate([s for s in shifts] + [-s for s in shifts]))


ISOTOPE_PROBE = next(i for i, s in _probe_shifts() if s == ION_SHIFTS["M+13C"])


def _distinct_points(peaks: DataFrame) -> DataFrame:
    """One row per (species, mass, rt): the peak with the smallest id stands for its copies."""
    return peaks.groupBy("species", "mass", "rt").agg(
        F.min(F.struct("peak_id", "intensity")).alias("_first"), F.count(F.lit(1)).alias("copies")
    ).select("species", "mass", "rt", F.col("_first.peak_id").alias("point"), F.col("_first.intensity").alias("partner_intensity"), "copies")


def _cells(points: DataFrame, cell_points: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points in cells, probes in cells, cells with over ``cell_points`` points and their ``_size``).

    A grid cell is as wide as the search window. Probes are looked up in their own cell, points
    are entered into every cell a matching probe may fall in.
    """
    wm, wr, slack = 2 * MASS_WINDOW, 2 * RT_WINDOW, 1e-9
    span = lambda c, half, w: F.sequence(
        F.floor((F.col(c) - half - slack) / w), F.floor((F.col(c) + half + slack) / w)
    )
    entered = (
        points.withColumn("_cm", F.explode(span("mass", MASS_WINDOW, wm)))
        .withColumn("_cr", F.explode(span("rt", RT_WINDOW, wr)))
    )
    probes = points.select(
        "species", F.col("mass").alias("origin_mass"), "rt", F.col("point").alias("origin"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("probe"), F.lit(s).alias("shift")) for i, s in _probe_shifts()])).alias("_p"),
    ).select(
        "species", "origin_mass", "rt", "origin", "_p.probe", (F.col("origin_mass") + F.col("_p.shift")).alias("mass"),
        F.concat_ws("_", F.col("origin").cast("string"), F.col("_p.probe").cast("string")).alias("probe_id"),
    ).withColumns({"_cm": F.floor(F.col("mass") / wm), "_cr": F.floor(F.col("rt") / wr)})
    sizes = entered.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_size"))
    # only the crowded cells are written, so that their own size decides how they are joined
    return entered, probes, stored(sizes.where(F.col("_size") > cell_points))


def _by_crowd(df: DataFrame, crowded: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """Rows in crowded cells (left_semi) or in the others (left_anti)."""
    return lookup_join(df, crowded.select(*_CELL), _CELL, how, hot=hot, max_bytes=CROWDED_BYTES)


def _origin(found: DataFrame, *values: str) -> DataFrame:
    """(point, probe, values) from the probe's id."""
    part = lambda i: F.split("probe_id", "_")[i]
    return found.select(part(0).cast("long").alias("point"), part(1).cast("int").alias("probe"), *values)


def partners(peaks: DataFrame, cell_points: int = CELL_POINTS) -> DataFrame:
    """(species, mass, rt, probe, partner_intensity): nearest peak at each ion shift, if any.

    Cells with few distinct points are joined directly; crowded ones are searched in mass order, so
    no cell produces all its pairs.
    """
    points = stored(_distinct_points(peaks))
    entered, probes, crowded = _cells(points, cell_points)
    # few cells can hold a large share of the points; only their rows are salted
    hot = hot_keys(crowded, _CELL, "_size")
    dense_points = entered.select(*_CELL, "mass", "rt", "point", "partner_intensity")
    if cell_points >= 1:
        found = _pairwise(probes, _by_crowd(entered, crowded, hot, "left_anti"))
        dense_points = _by_crowd(dense_points, crowded, hot, "left_semi")
    if cell_points < 1 or not crowded.isEmpty():
        # probes of crowded cells; every one keeps its cell as the search key. A limit below one makes
        # every cell crowded that has a point at all
        dense_probes = _by_crowd(probes.select(*_CELL, "mass", "rt", "probe_id"), crowded, hot, "left_semi")
        near = settled(lambda: nearest_within_box(
            dense_points, dense_probes, _CELL, "rt", RT_WINDOW, "mass", MASS_WINDOW, "point", "probe_id", ["partner_intensity"]
        ).select("probe_id", "partner_intensity"))
        found = near if cell_points < 1 else found.unionByName(near)
    return grown_join(_origin(found, "partner_intensity"), points.select("point", "species", "mass", "rt"), ["point"])


def pair_counts(peaks: DataFrame, cell_points: int = CELL_POINTS) -> DataFrame:
    """(species, ion, direction, n_pairs, n_peaks): pairs of peaks of a species that are one ion shift
    apart in mass and close in time, and the peaks that have such a partner above (direction 1) or
    below (-1). Combinations without a pair are absent; peaks without mass or time have no partners.

    Pairs are formed in cells of few points only; in crowded ones they are differences of running
    counts. Equal points count as often as they occur, on either side.
    """
    points = stored(_distinct_points(peaks.where("mass IS NOT NULL AND rt IS NOT NULL")))
    entered, probes, crowded = _cells(points, cell_points)
    hot = hot_keys(crowded, _CELL, "_size")
    sparse = _near_pairs(probes, _by_crowd(entered, crowded, hot, "left_anti"))
    found = sparse.groupBy("probe_id").agg(F.sum("copies").alias("n"))
    if not crowded.isEmpty():
        dense_points = _by_crowd(entered.select(*_CELL, "mass", "rt", "point", "copies"), crowded, hot, "left_semi")
        dense_probes = _by_crowd(probes.select(*_CELL, "mass", "rt", "probe_id"), crowded, hot, "left_semi")
        dense = counts_of_probes(dense_points, dense_probes, _CELL, "rt", RT_WINDOW, "mass", MASS_WINDOW, "point", "probe_id", "copies", "n")
        # a probe has one cell; those without a partner have a difference of zero
        found = found.unionByName(dense.where("n > 0").select("probe_id", "n"))
    ions = [n for n, s in ION_SHIFTS.items() if s != 0.0]
    joined = grown_join(_origin(found, "n"), points.select("point", "species", "copies"), ["point"])
    return joined.groupBy(
        "species", F.get(F.array(*[F.lit(n) for n in ions]), F.col("probe") % len(ions)).alias("ion"),
        F.when(F.col("probe") < len(ions), 1).otherwise(-1).alias("direction"),
    ).agg(F.sum(F.col("n") * F.col("copies")).alias("n_pairs"), F.sum("copies").alias("n_peaks"))


def _near_pairs(probes: DataFrame, points: DataFrame) -> DataFrame:
    """Probes with the points in their window, compared directly inside cells of bounded size."""
    right = points.select(
        *_CELL, F.col("mass").alias("_pm"), F.col("rt").alias("_pr"), "point", "partner_intensity", "copies"
    )
    # a point is in several cells and has a dozen probes, which sizes of their table do not tell
    return lookup_join(probes, right, _CELL, "inner", max_bytes=GROWING_BYTES).where(
        (F.abs(F.col("_pm") - F.col("mass")) < MASS_WINDOW) & (F.abs(F.col("_pr") - F.col("rt")) < RT_WINDOW)
    )


def _pairwise(probes: DataFrame, points: DataFrame) -> DataFrame:
    pairs = _near_pairs(probes, points)
    near = F.min(F.struct(F.abs(F.col("_pm") - F.col("mass")).alias("d"), "point", "partner_intensity"))
    return pairs.groupBy("probe_id").agg(near.alias("_n")).select("probe_id", F.col("_n.partner_intensity").alias("partner_intensity"))


def partner_features(peaks: DataFrame, cell_points: int = CELL_POINTS) -> DataFrame:
    """(peak_id, has_isotope, isotope_score, n_adducts)."""
    per_point = partners(peaks, cell_points).groupBy("species", "mass", "rt").agg(
        F.count(F.lit(1)).cast("double").alias("n_adducts"),
        F.max(F.when(F.col("probe") == ISOTOPE_PROBE, F.col("partner_intensity"))).alias("_iso"),
    )
    joined = grown_join(peaks.select("peak_id", "species", "mass", "rt", "intensity"), per_point, ["species", "mass", "rt"], "left")
    return joined.select(
        "peak_id",
        F.col("_iso").isNotNull().cast("double").alias("has_isotope"),
        isotope_score(F.col("_iso") / F.col("intensity")).alias("isotope_score"),
        F.coalesce("n_adducts", F.lit(0.0)).alias("n_adducts"),
    )


def coelution_counts(peaks: DataFrame) -> DataFrame:
    """(peak_id, rt_cluster_size): peaks of the species at nearly the same time, itself included."""
    counts = counts_within(peaks, ["species"], "rt", RT_WINDOW, "rt_cluster_size")
    return grown_join(peaks.select("peak_id", "species", "rt"), counts, ["species", "rt"]).select(
        "peak_id", F.col("rt_cluster_size").cast("double").alias("rt_cluster_size")
    )


def correlated_counts(peaks: DataFrame) -> DataFrame:
    """(peak_id, n_correlated): other peaks close in time and in log intensity."""
    marked = peaks.select("peak_id", "species", "rt", F.log1p("intensity").alias("_li"))
    marked = stored(marked)
    counts = counts_within_box(marked, ["species"], "rt", CORRELATION_RT, "_li", CORRELATION_LOG, "_n")
    return grown_join(marked, counts, ["species", "rt", "_li"]).select(
        "peak_id", F.greatest(F.col("_n") - 1, F.lit(0)).cast("double").alias("n_correlated")
    )


def signal_to_noise(peaks: DataFrame) -> DataFrame:
    """Intensity over the species' tenth percentile."""
    floor = exact_percentiles(peaks, ["species"], "intensity", {"_p10": NOISE_FRACTION})
    return lookup_join(peaks, floor, ["species"], "left").withColumn(
        "snr", F.col("intensity") / (F.col("_p10") + F.lit(1e-9))
    ).drop("_p10")


def context_features(peaks: DataFrame) -> DataFrame:
    """All context features, one row per peak."""
    base = stored(peaks.select("peak_id", "species", "mass", "rt", "intensity"))
    out = signal_to_noise(base).select("peak_id", "snr")
    for part in (partner_features, coelution_counts, correlated_counts):
        out = grown_join(out, settled(lambda: part(base)), ["peak_id"])
    return out
