"""Plan shapes give the plain answer on skewed inputs, on every path."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom.operators import context as X
from peakloom.operators import preparation as P
from peakloom.plans import durable as D
from peakloom.plans import joins as J
from peakloom.plans import ordered as O
from peakloom.plans.topk import top_k_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key; values repeat."""
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": np.round(rng.normal(size=n), 2), "w": np.round(rng.normal(size=n), 2)})
    return spark.createDataFrame(pdf).repartition(6, "id"), pdf


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("named", [True, False])
def test_salted_join_equals_plain_join(spark, skewed, how, named):
    facts, _ = skewed
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40)], "k long, name string")
    hot = J.hot_keys(facts.groupBy("k").count(), ["k"], "count", 0.1) if named else None
    out = J.lookup_join(facts, dim, ["k"], how, hot, max_bytes=-1, salts=5)
    plain = facts.join(dim, ["k"], how)
    assert out.columns == plain.columns
    assert rows(out, "id", *out.columns) == rows(plain, "id", *plain.columns)


def test_hot_keys_are_bounded(skewed):
    facts, _ = skewed
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [r["k"] for r in J.hot_keys(counts, ["k"], "n", share=0.3).collect()] == [7]


def test_size_checks_run_no_job_and_move_no_rows_to_one_task(spark, skewed):
    facts, _ = skewed
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizes", "size checks")
    dim = spark.range(100).withColumnRenamed("id", "k")
    joined = J.lookup_join(facts, dim, ["k"])
    assert len(tracker.getJobIdsForGroup("sizes")) == 0
    spark.sparkContext.setJobGroup("rest", "")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("task_bytes", [-1, 1 << 40])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ordered_scan(skewed, keys, task_bytes):
    facts, pdf = skewed
    got = O.ordered_scan(
        facts, keys, ["v", "id"], {"s": "id"}, {"m": "w"}, {"f": "w"}, totals=True, task_bytes=task_bytes
    ).toPandas().sort_values("id")
    want = pdf.sort_values([*keys, "v", "id"])
    group = want.groupby(keys) if keys else want.assign(z=0).groupby("z")
    want = want.assign(
        s=group["id"].cumsum(), m=group["w"].cummax(), t=group["id"].transform("sum"),
        f=group["w"].transform(lambda c: c[::-1].cummin()[::-1]),
    ).sort_values("id")
    assert (got["s"].to_numpy() == want["s"].to_numpy()).all()
    assert (got["s_total"].to_numpy() == want["t"].to_numpy()).all()
    assert (got["m"].to_numpy() == want["m"].to_numpy()).all()
    assert (got["f"].to_numpy() == want["f"].to_numpy()).all()


@pytest.mark.parametrize("task_bytes", [-1, 1 << 40])
def test_exact_percentiles(skewed, monkeypatch, task_bytes):
    monkeypatch.setattr(O, "TASK_BYTES", task_bytes)
    facts, pdf = skewed
    got = {r["k"]: r for r in O.exact_percentiles(facts, ["k"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k]["p10"] == pytest.approx(np.percentile(part["v"], 10), abs=1e-12)
        assert got[k]["p50"] == pytest.approx(np.median(part["v"]), abs=1e-12)


@pytest.mark.parametrize("task_bytes", [-1, 1 << 40])
def test_window_counts_against_brute_force(skewed, monkeypatch, task_bytes):
    monkeypatch.setattr(O, "TASK_BYTES", task_bytes)
    facts, pdf = skewed
    one = {(r["k"], r["v"]): r["n"] for r in O.counts_within(facts, ["k"], "v", 0.25, "n").collect()}
    box = {(r["k"], r["v"], r["w"]): r["n"] for r in O.counts_within_box(facts, ["k"], "v", 0.25, "w", 0.5, "n").collect()}
    for k, part in pdf.groupby("k"):
        v, w = part["v"].to_numpy(), part["w"].to_numpy()
        for a, b in zip(v, w):
            near = np.abs(v - a) < 0.25
            assert one[(k, a)] == near.sum()
            assert box[(k, a, b)] == (near & (np.abs(w - b) < 0.5)).sum()


@pytest.fixture(scope="module")
def crowded_peaks(spark):
    """A third of the peaks sit in one cell, some of them as exact copies."""
    rng = np.random.default_rng(3)
    n = 600
    hot = rng.random(n) < 0.4
    shift = rng.choice([0.0, 1.00335, 21.9819, -18.0106], n)
    mass = np.where(hot, 300.0, rng.uniform(200, 210, n)) + shift + np.round(rng.normal(0, 0.006, n), 4)
    pdf = pd.DataFrame(
        {
            "peak_id": np.arange(n), "species": rng.integers(0, 2, n), "mass": mass,
            "rt": np.where(hot, 5 + np.round(rng.normal(0, 0.06, n), 3), np.round(rng.uniform(1, 9, n), 3)),
            "intensity": np.round(rng.uniform(1, 1000, n), 2),
        }
    )
    pdf = pd.concat([pdf, pdf.iloc[:30].assign(peak_id=np.arange(n, n + 30))], ignore_index=True)
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("cell_points,task_bytes", [(64, 1 << 40), (5, 1 << 40), (0, -1)])
def test_partner_features_against_brute_force(crowded_peaks, monkeypatch, cell_points, task_bytes):
    monkeypatch.setattr(O, "TASK_BYTES", task_bytes)
    df, pdf = crowded_peaks
    got = X.partner_features(df, cell_points).toPandas().set_index("peak_id")
    shifts = [s for s in X.ION_SHIFTS.values() if s]
    for r in pdf.itertuples():
        part = pdf[(pdf["species"] == r.species) & ((pdf["rt"] - r.rt).abs() < 0.1)]
        n = sum(((part["mass"] - (r.mass + sign * s)).abs() < 0.01).any() for s in shifts for sign in (1, -1))
        gap = (part["mass"] - (r.mass + 1.00335)).abs()
        near = gap[gap < 0.01]
        assert got.loc[r.peak_id, "n_adducts"] == n
        assert got.loc[r.peak_id, "has_isotope"] == float(len(near) > 0)
        if len(near):
            ratio = part.loc[near.idxmin(), "intensity"] / r.intensity
            want = 1.0 if 0.11 <= ratio <= 0.33 else 0.7 if 0.05 <= ratio <= 0.55 else 0.3
            assert got.loc[r.peak_id, "isotope_score"] == want


@pytest.mark.parametrize("cell_points,task_bytes", [(64, 1 << 40), (5, 1 << 40), (0, -1)])
def test_pair_counts_against_brute_force(crowded_peaks, monkeypatch, cell_points, task_bytes):
    monkeypatch.setattr(O, "TASK_BYTES", task_bytes)
    df, pdf = crowded_peaks
    got = {(r["species"], r["ion"], r["direction"]): (r["n_pairs"], r["n_peaks"]) for r in X.pair_counts(df, cell_points).collect()}
    want = {}
    for r in pdf.itertuples():
        part = pdf[(pdf["species"] == r.species) & ((pdf["rt"] - r.rt).abs() < 0.1)]
        for ion, shift in X.ION_SHIFTS.items():
            for direction in (1, -1):
                n = ((part["mass"] - (r.mass + direction * shift)).abs() < 0.01).sum() if shift else 0
                if n:
                    pairs, peaks = want.get((r.species, ion, direction), (0, 0))
                    want[r.species, ion, direction] = (pairs + n, peaks + 1)
    assert got == want and len(want) > 8


def test_top_k_is_exact_under_skew(skewed):
    facts, pdf = skewed
    got = top_k_per_group(facts, ["k"], [F.desc("v"), F.col("id")], 3, ["id"], salts=4, rank="r")
    want = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True]).groupby("k").head(3)
    assert rows(got, "k", "id") == sorted(zip(want["k"], want["id"]))


def test_capped_sample_ignores_partitioning(skewed):
    facts, pdf = skewed
    a = rows(P.capped_sample(facts, ["k"], 4, ["id"]), "id")
    b = rows(P.capped_sample(facts.repartition(3, "v"), ["k"], 4, ["id"]), "id")
    assert a == b
    sizes = pdf["k"].value_counts().clip(upper=4)
    assert len(a) == sizes.sum()
    assert a != rows(P.capped_sample(facts, ["k"], 4, ["id"], seed=1), "id")


def test_null_keys_are_not_sampled(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, k long")
    assert rows(P.capped_sample(df, ["k"], 1, ["id"]), "id") == [(2,)]
    with pytest.raises(ValueError):
        P.capped_sample(df, ["k"], 0, ["id"])


def test_mass_join_has_no_product(spark):
    """Large libraries are matched by an equi-join on bins."""
    from peakloom.operators.candidates import mass_matches

    lib = spark.range(300).selectExpr("id AS compound_id", "100e0 + id * 0.01 AS mass", "false AS is_decoy")
    peaks = spark.range(200).selectExpr("id AS peak_id", "0L AS species", "100e0 + id * 0.013 AS mass", "1e0 AS rt", "1e0 AS intensity")
    plan = mass_matches(peaks, lib)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_stored_tables_leave_no_shuffle_files_and_settled_ones_no_steps(spark, tmp_path):
    """What a written table was made from takes no disk any more."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    steps = []

    def build():
        steps.append(D.stored(spark.range(1000).repartition(4, "id")))
        steps.append(D.settled(lambda: steps[0].groupBy(F.col("id") % 7).count(), keep=True))
        return steps[0].groupBy((F.col("id") % 10).alias("k")).count()

    before = spark.conf.get(setting, None)
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    out = D.settled(build)
    assert spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size() <= shuffles
    assert rows(out, "k", "count") == [(k, 100) for k in range(10)] and spark.conf.get(setting, None) == before
    assert [os.path.exists(df._stored_at.removeprefix("file:")) for df in (*steps, out)] == [False, True, True]
    assert D._open.scopes == []


@pytest.mark.parametrize("task_rows", [100, 1, 10_000])
def test_large_tables_of_small_keys_are_dealt_by_key(spark, skewed, monkeypatch, task_rows):
    """Only keys with many rows are cut into ranges; null is a key, and the result is the plain one."""
    facts, _ = skewed
    facts = facts.withColumn("k", F.when(F.col("k") != 3, F.col("k")))
    scan = lambda size: O.ordered_scan(facts, ["k"], ["v", "id"], {"s": "id"}, {"m": "w"}, {"f": "w"}, totals=True, task_bytes=size)
    cols = ["id", "k", "v", "s", "s_total", "m", "f"]
    want = sorted(map(str, scan(1 << 40).select(cols).collect()))
    cut, chunked = [], O._chunked_scan
    monkeypatch.setattr(O, "TASK_ROWS", task_rows)
    monkeypatch.setattr(O, "_chunked_scan", lambda df, *rest: cut.append(df.select("k").distinct().count()) or chunked(df, *rest))
    assert sorted(map(str, scan(1).select(cols).collect())) == want
    assert cut == {100: [1], 1: [49], 10_000: []}[task_rows]


def test_points_are_entered_at_the_levels_of_their_own_key(spark):
    points = spark.createDataFrame([(k, float(i)) for k, n in ((1, 1), (2, 9)) for i in range(n)], "k int, x double")
    placed, ranged = O.range_blocks(*O.window_ranges(points, points, ["k"], "x", 100.0, ["x"], ["x"]))
    assert rows(placed.groupBy("k").agg(F.max("_level").alias("top")), "k", "top") == [(1, 0), (2, 3)]
    met = ranged.join(placed.select("k", "_level", "_block", F.col("x").alias("y")), ["k", "_level", "_block"]).groupBy("k", "x").count()
    assert rows(met, "k", "count") == [(1, 1)] + [(2, 9)] * 9
