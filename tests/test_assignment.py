"""Candidates, priors, probabilities, labelling and curation on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom.operators import assignment as A
from peakloom.operators import candidates as C
from peakloom.operators import context as X
from peakloom.operators import curation as U
from peakloom.operators import labelling as L
from peakloom.operators import presence as PR


def test_context_features(spark):
    peaks = spark.createDataFrame(
        [(0, 0, 500.0, 5.0, 1e6), (1, 0, 521.9819, 5.004, 5e5), (2, 0, 481.9894, 5.002, 3e5), (3, 0, 501.00335, 5.001, 2e5)],
        "peak_id long, species long, mass double, rt double, intensity double",
    )
    got = {r["peak_id"]: r for r in X.context_features(peaks).collect()}
    assert [got[i]["n_adducts"] for i in (0, 1, 2)] == [3.0, 1.0, 1.0]
    assert got[0]["has_isotope"] == 1.0 and got[0]["isotope_score"] == 1.0
    assert got[0]["rt_cluster_size"] == 4.0
    assert got[0]["snr"] == pytest.approx(1e6 / (np.percentile([1e6, 5e5, 3e5, 2e5], 10) + 1e-9))


def test_batch_prior(spark):
    labelled = spark.createDataFrame([(0, 0), (0, None), (0, None), (0, None), (0, None)], "species long, compound_id long")
    prior, null = PR.batch_update(labelled)
    assert prior.first()["alpha"] == 2.0
    n = null.first()
    assert n["alpha_null"] == pytest.approx(1 + math.log1p(4)) and n["beta_null"] == pytest.approx(1 + math.log1p(1))
    assert PR.log_null(null) == pytest.approx(math.log(n["alpha_null"] / (n["alpha_null"] + n["beta_null"])))


def test_interactive_prior_updates_commute(spark):
    cand = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "peak_id long, compound_id long")
    one = spark.createDataFrame([(1, 0, 10)], "peak_id long, species long, compound_id long")
    two = spark.createDataFrame([(2, 0, None)], "peak_id long, species long, compound_id long")
    both = PR.label_events(one.unionByName(two), cand)
    start = PR.initial_prior(one.where("1 = 0"))
    got = {r["compound_id"]: (r["alpha"], r["beta"]) for r in PR.apply_events(start, both).collect()}
    assert got == {10: (2.0, 1.0), 11: (1.0, 1.25)}
    null = spark.createDataFrame([(1.0, 1.0)], "alpha_null double, beta_null double")
    assert tuple(PR.apply_null_events(null, both).first()) == (2.0, 2.0)
    split = PR.label_events(one, cand).unionByName(PR.label_events(two, cand)).groupBy("species", "compound_id").agg(
        F.sum("d_alpha").alias("d_alpha"), F.sum("d_beta").alias("d_beta"))
    key = lambda r: repr(tuple(r))
    assert sorted(split.collect(), key=key) == sorted(both.select(*split.columns).collect(), key=key)


@pytest.fixture(scope="module")
def small(spark):
    """Two peaks among six near masses, wide time windows."""
    peaks = spark.createDataFrame(
        [(0, 0, 100.004, 5.5, 1e5, 1), (1, 0, 100.007, 5.4, 2e5, None)],
        "peak_id long, species long, mass double, rt double, intensity double, true_compound long",
    )
    masses = [100.0, 100.005, 100.01, 100.012, 110.0, 120.0]
    lib = spark.createDataFrame([(i, m, i == 3) for i, m in enumerate(masses)], "compound_id long, mass double, is_decoy boolean")
    pred = spark.createDataFrame([(0, i, 5.5, 0.5) for i in range(6)], "species long, compound_id long, rt_mean double, rt_std double")
    return peaks, lib, pred


def test_candidates_by_brute_force(spark, small):
    peaks, lib, pred = small
    got = {(r["peak_id"], r["compound_id"]) for r in C.mass_matches(peaks, lib, 150.0).collect()}
    want = {
        (p["peak_id"], c["compound_id"]) for p in peaks.collect() for c in lib.collect()
        if any(abs(p["mass"] - (c["mass"] + s)) <= 150 * (c["mass"] + s) * 1e-6 for s in C.ION_SHIFTS.values() if c["mass"] + s >= 0)
    }
    assert got == want and len(want) == 8
    cand = C.generate(peaks, lib, pred, X.context_features(peaks), 150.0, 10.0)
    slots = C.number_slots(cand, peaks)
    assert slots.where("slot = 0").count() == 2
    label = {r["peak_id"]: r["label"] for r in slots.select("peak_id", "label").distinct().collect()}
    assert label == {0: 2, 1: 0}


def test_the_closest_ion_is_kept_in_huge_windows(spark):
    peaks = spark.createDataFrame([(0, 0, 100.4, 1.0, 1.0), (1, 0, 100.6, 1.0, 1.0)], "peak_id long, species long, mass double, rt double, intensity double")
    lib = spark.createDataFrame([(7, 100.0, False)], "compound_id long, mass double, is_decoy boolean")
    got = C.mass_matches(peaks, lib, 10000.0).orderBy("peak_id").collect()
    assert [(r["compound_id"], r["ion"]) for r in got] == [(7, "M+H"), (7, "M+13C")]


def test_one_join_on_mass_and_time_equals_two_steps(spark):
    rng = np.random.default_rng(5)
    masses = [100.0 + 0.004 * i for i in range(30)] + [118.0338, 121.98, 56.01]
    lib = spark.createDataFrame([(i, float(m), False) for i, m in enumerate(masses)], "compound_id long, mass double, is_decoy boolean")
    pred = spark.createDataFrame(
        [(s, i, float(rng.uniform(0, 3)), float(rng.choice([0.0, 0.1, 0.9]))) for s in (0, 1) for i in range(len(masses)) if (s + i) % 7], "species long, compound_id long, rt_mean double, rt_std double"
    )
    peaks = spark.createDataFrame(
        [(i, int(i % 3), float(rng.choice(masses) + rng.choice([0.0, 1.00335, 21.9819, -18.0106]) + rng.normal(0, 1e-3)), float(rng.uniform(-0.2, 3.2)), 1.0) for i in range(600)],
        "peak_id long, species long, mass double, rt double, intensity double",
    )
    for ppm, k, floor in ((10.0, 1.5, 0.05), (500.0, 4.0, 0.2)):
        columns = ["peak_id", "species", "mass", "rt", "intensity", "compound_id", "ion", "theoretical", "rt_mean", "rt_std", "rt_z"]
        two = C.rt_matches(C.mass_matches(peaks, lib, ppm), pred, k, floor).select(*columns)
        for width in (0.05, 0.5, 10.0):
            one = C.window_matches(peaks, lib, pred, ppm, k, floor, rt_bin=width).select(*columns)
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
        assert two.count() > 20


def test_ions_and_predictions_of_a_large_library_are_not_broadcast(spark):
    n = 60_000  # some 600,000 rows of ions and bins
    lib = spark.range(n).selectExpr("id AS compound_id", "100 + 0.03 * id AS mass", "id % 4 = 3 AS is_decoy")
    pred = spark.range(n).selectExpr("0L AS species", "id AS compound_id", "id % 9 * 1D AS rt_mean", "0.1D AS rt_std")
    peaks = spark.range(n).selectExpr("id AS peak_id", "0L AS species", "100 + 0.03 * id AS mass", "id % 9 * 1D AS rt", "1D AS intensity", "id AS true_compound")
    context = peaks.select("peak_id", *[F.lit(0.0).alias(c) for c in C.CONTEXT])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(C.mass_matches(peaks, lib)) + plan(C.window_matches(peaks, lib, pred))
    assert "BroadcastHashJoin [compound_id" not in plan(C.generate(peaks, lib, pred, context))


def test_tables_that_grow_with_the_peaks_are_not_broadcast(spark):
    n = 60_000  # a few bytes a row as Parquet
    peaks = spark.range(n).selectExpr("id AS peak_id", "0L AS species", "100 + 0.05 * id AS mass", "0.1 * id AS rt", "1D + id % 7 AS intensity", "id AS true_compound")
    probs = peaks.selectExpr("peak_id", "1 AS slot", "true_compound AS compound_id", "0.9D AS p")
    truth = peaks.select("peak_id", "true_compound")
    pairs = A.evaluation_pairs(probs, A.assign(probs, 0.3), truth)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (X.coelution_counts(peaks), X.correlated_counts(peaks), pairs, A.peak_metrics(pairs, truth)):
        assert "BroadcastHashJoin" not in plan(df)
    assert X.correlated_counts(peaks).agg(F.count("*"), F.sum("n_correlated")).first()[0] == n


def test_repeated_ids_have_one_row_per_compound(spark):
    peaks = spark.createDataFrame([(i, 0, m, 1.0, 1.0) for i, m in ((0, 100.4), (1, 100.6), (2, 119.0))], "peak_id long, species long, mass double, rt double, intensity double")
    lib = spark.createDataFrame([(7, 100.0, False), (8, 101.0, True)], "compound_id long, mass double, is_decoy boolean")
    pred = spark.createDataFrame([(0, 7, 1.0, 0.5), (0, 8, 1.0, 0.5)], "species long, compound_id long, rt_mean double, rt_std double")
    twice = lambda df: df.unionByName(df)
    for find in (lambda p, c: C.mass_matches(p, c, 10000.0), lambda p, c: C.window_matches(p, c, pred, 10000.0)):
        once = sorted(map(tuple, find(peaks, lib).collect()))
        assert len(once) == len({(r[0], r[5]) for r in once}) > 4
        assert sorted(map(tuple, find(twice(peaks), lib).collect())) == once
        assert sorted(map(tuple, find(peaks, twice(lib)).collect())) == once


def test_decoy_flags_come_with_the_ions(spark, small):
    """Candidates are not dealt by compound once more for a flag; repeated compounds still repeat."""
    peaks, library, rt_pred = small
    library = library.withColumn("is_decoy", F.col("compound_id") == 1)
    context = X.context_features(peaks)
    one = C.generate(peaks, library, rt_pred, context)
    twice = C.generate(peaks, library.unionAll(library), rt_pred, context)
    key = lambda df: sorted(map(tuple, df.select("peak_id", "compound_id", "ion", "is_decoy", F.round("rt_z", 9)).collect()))
    assert key(twice) == sorted(key(one) * 2) and any(r[3] for r in key(one))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(one) == joins(twice) - 1


def test_training_rows_leave_decoys_out(spark, small):
    peaks, lib, pred = small
    cand = C.generate(peaks, lib, pred, X.context_features(peaks), 150.0, 10.0)
    rows = C.training_rows(cand)
    assert len(C.FEATURES) == 16 and rows.columns == ["peak_id", "species", "compound_id", *C.FEATURES]
    assert rows.count() == cand.where("compound_id <> 3").count() < cand.count()


def test_probabilities_do_not_depend_on_candidate_order(spark, small):
    peaks, lib, pred = small
    relabel = lib.withColumn("compound_id", 5 - F.col("compound_id"))
    repred = pred.withColumn("compound_id", 5 - F.col("compound_id"))
    ctx = X.context_features(peaks)

    def probs(library, prediction):
        cand = C.generate(peaks, library, prediction, ctx, 150.0, 10.0)
        slots = C.number_slots(cand, peaks)
        none = PR.initial_prior(peaks.select("species", F.col("true_compound").alias("compound_id")).where("1 = 0"))
        return A.probabilities(A.with_log_prior(slots, none, math.log(0.5)), {"mass_err_ppm": -0.05, "rt_z": 0.4}, 0.3, -0.2)

    a = {(r["peak_id"], r["compound_id"]): r["p"] for r in probs(lib, pred).where("slot > 0").collect()}
    b = {(r["peak_id"], 5 - r["compound_id"]): r["p"] for r in probs(relabel, repred).where("slot > 0").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-10 for k in a)


@pytest.fixture(scope="module")
def probs(spark):
    rows = [(1, 0, None, 0.1), (1, 1, 10, 0.7), (1, 2, 11, 0.2), (2, 0, None, 0.6), (2, 1, 10, 0.4), (3, 0, None, 1.0), (4, 0, None, 0.05), (4, 1, 12, 0.5), (4, 2, 13, 0.45)]
    return spark.createDataFrame(rows, "peak_id long, slot int, compound_id long, p double")


def test_assignment_metrics(spark, probs):
    truth = spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 14)], "peak_id long, true_compound long")
    chosen = A.assign(probs, 0.4, 2)
    assert {(r["peak_id"], r["compound_id"]) for r in chosen.collect()} == {(1, 10), (2, 10), (4, 12), (4, 13)}
    pairs = A.evaluation_pairs(probs, chosen, truth)
    assert pairs.count() == 6  # five candidates and the true compound that is none of them
    m = A.pair_metrics(pairs).first()
    assert (m["tp"], m["fp"], m["fn"]) == (2, 2, 1)
    k = A.peak_metrics(pairs, truth).first()
    assert k["f1_macro"] == pytest.approx((1 + 1 + 1 + 0) / 4) and k["far_null"] == 0 and k["tnr_null"] == 1
    assert k["assignment_rate"] == 0.75 and k["cardinality_mae"] == 0.25
    decoys = spark.createDataFrame([(13, True), (12, False)], "compound_id long, is_decoy boolean")
    c = A.compound_metrics(chosen, truth, decoys).first()
    assert (c["identified"], c["total"], c["false_positives"], c["missed"], c["decoys_assigned"]) == (1, 2, 2, 1, 1)
    labelled = spark.createDataFrame([(4,)], "peak_id long")
    e = A.evaluate(probs, truth, decoys, 0.4, labelled=labelled).first()
    assert (e["tp"], e["fp"], e["fn"]) == (2, 0, 0)


def test_draws(spark, probs):
    slots = probs.select("peak_id", "slot", "compound_id", F.log("p").alias("log_pi"), F.lit(0.0).alias("x"))
    draws = [{"theta0": 0.0, "theta_null": 0.0, "theta": {"x": 0.0}, "sigma_logit": 0.3} for _ in range(3)]
    clean = A.draw_probabilities(slots, draws)
    mean = {(r["peak_id"], r["slot"]): r["p"] for r in A.mean_probabilities(clean).collect()}
    assert all(mean[(r["peak_id"], r["slot"])] == pytest.approx(r["p"]) for r in probs.collect())
    noisy = A.draw_probabilities(slots, draws, noise_seed=1)
    again = A.draw_probabilities(slots.repartition(3), draws, noise_seed=1)
    key = lambda df: sorted((r["peak_id"], r["slot"], r["draw"], round(r["p"], 12)) for r in df.collect())
    assert key(noisy) == key(again) != key(clean)
    assert A.mean_probabilities(noisy, max_samples=1).groupBy("peak_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    for many in (draws, A.draw_table(slots, draws)):
        both = A.mean_draw_probabilities(slots, many, noise_seed=1, block=2)
        assert sorted((r["peak_id"], r["slot"], round(r["p"], 9)) for r in both.collect()) == sorted(
            (r["peak_id"], r["slot"], round(r["p"], 9)) for r in A.mean_probabilities(noisy).collect()
        )
    plan = A.mean_draw_probabilities(slots, draws, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    mi = {r["peak_id"]: r["score"] for r in L.mutual_information(noisy).collect()}
    assert all(v >= -1e-12 for v in mi.values())
    with pytest.raises(ValueError):
        A.draw_probabilities(slots, [])


def test_draws_of_odd_rows(spark, monkeypatch):
    """Nulls make a peak's probabilities null, repeated rows are added up, noise is that of the SQL hash;
    a few logits at a time and a batch per row change nothing, and no row is made per slot and draw."""
    from peakloom.functions.values import hash_fraction

    rows = [(1, 0, None, None, -0.7), (1, 1, 10, 0.5, -0.2), (1, 1, 10, 0.5, -0.2), (2, 0, None, None, -0.7), (2, 1, 11, None, -0.2), (None, 0, None, None, -0.7), (None, 1, 12, 1.0, 0.1), (3, 0, None, None, 0.0)]
    slots = spark.createDataFrame(rows, "peak_id long, slot int, compound_id long, x double, log_pi double").coalesce(1)
    draws = [{"theta0": 0.1 * i, "theta_null": 0.2, "theta": {"x": 1.0 - i}, "sigma_logit": 0.5} for i in range(3)]
    table = spark.createDataFrame([(i,) for i in range(3)], "draw int")
    unit = slots.select("peak_id", "slot").distinct().crossJoin(table)
    unit = unit.select("*", *[hash_fraction(["peak_id", "slot", "draw"], s).alias(f"u{s}") for s in (7, 8)])
    noise = {(r["peak_id"], r["slot"], r["draw"]): 0.5 * math.sqrt(-2 * math.log(max(r["u7"], 1e-12))) * math.cos(2 * math.pi * r["u8"]) for r in unit.collect()}
    want = {}
    for peak in (1, 2, 3, None):
        for d, w in enumerate(draws):
            own = [r for r in rows if r[0] == peak]
            e = [None if r[1] and r[3] is None else math.exp((w["theta0"] + w["theta"]["x"] * r[3] if r[1] else 0.2) + r[4] + noise[peak, r[1], d]) for r in own]
            for r, v in zip(own, e):
                want.setdefault((peak, r[1], r[2]), []).append(None if None in e else v / sum(e))
    for logits in (1, 1_000_000):
        monkeypatch.setattr(A, "_LOGITS", logits)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1" if logits == 1 else "10000")
        try:
            long, mean = (f(slots, draws, noise_seed=7) for f in (A.draw_probabilities, A.mean_draw_probabilities))
            got = {}
            for r in long.collect():
                got.setdefault((r["peak_id"], r["slot"], r["compound_id"]), []).append(r["p"])
            assert {k: sorted(map(str, (v and round(v, 9) for v in p))) for k, p in got.items()} == {k: sorted(map(str, (v and round(v, 9) for v in p))) for k, p in want.items()}
            means = {(r["peak_id"], r["slot"], r["compound_id"]): r["p"] for r in mean.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert means == {k: None if None in p else pytest.approx(sum(p) / len(p), abs=1e-12) for k, p in want.items()}
        plan = long._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "lambda" not in plan


def test_acquisition(probs):
    score = lambda name, **k: {r["peak_id"]: r["score"] for r in L.acquisition(probs, name, **k).collect()}
    assert score("fp", threshold=0.6)[1] == pytest.approx(0.3) and score("fp", threshold=0.6)[2] == 0
    assert score("lc")[4] == pytest.approx(0.5)
    assert score("margin")[1] == pytest.approx(-0.5) and score("margin")[3] == 0
    h = -(0.1 * math.log(0.1) + 0.7 * math.log(0.7) + 0.2 * math.log(0.2))
    assert score("entropy")[1] == pytest.approx(h)
    assert score("hybrid", threshold=0.6)[1] == pytest.approx(0.7 * 0.3 + 0.3 * h)
    with pytest.raises(ValueError, match="unknown"):
        L.acquisition(probs, "random")
    with pytest.raises(ValueError, match="samples"):
        L.acquisition(probs, "mi")


def test_batches_exclude_history_and_spread_out(spark, probs):
    first = L.next_batch(probs, None, 1, "entropy")
    second = L.next_batch(probs, first, 10, "entropy")
    assert first.count() == 1 and second.join(first, ["peak_id"]).count() == 0 and second.count() == 3
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    vec = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "peak_id long, u double, v double")
    scores = spark.createDataFrame([(i, float(40 - i)) for i in range(40)], "peak_id long, score double")
    got = [r["peak_id"] for r in L.diverse_batch(scores, vec, ["u", "v"], 6, 25).orderBy("pick").collect()]
    want = [0]
    while len(want) < 6:
        gaps = [min(np.linalg.norm(x[i] - x[j]) for j in want) if i not in want else -1 for i in range(25)]
        want.append(int(np.argmax(gaps)))
    assert got == want
    with pytest.raises(ValueError):
        L.diverse_batch(scores, vec, ["u", "v"], 6, 0)
    assert [r["pick"] for r in L.diverse_batch(scores, vec, ["u", "v"], 50, 10**6).orderBy(F.desc("score")).collect()] == list(range(1, 41))


def test_fitted_weights_maximise_the_posterior(spark):
    rng = np.random.default_rng(6)
    rows, data = [], []
    for p in range(200):
        k = int(rng.integers(1, 4))
        x = rng.normal(size=(k, 2))
        eta = np.concatenate([[-0.3], 0.5 + x @ [1.0, -0.7]])
        y = int(rng.choice(k + 1, p=np.exp(eta) / np.exp(eta).sum())) if p % 10 else -1
        data.append((x, y))
        rows.append((p, 0, y, 0.0, None, None))
        rows += [(p, i + 1, y, 0.0, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "peak_id long, slot int, label int, log_pi double, a double, b double")
    fit = A.fit_weights(df, ["a", "b"])
    w = np.array([fit["theta_null"], fit["theta0"], fit["theta"]["a"], fit["theta"]["b"]])

    def objective(v):
        total = -0.5 * v @ v
        for x, y in data:
            if y >= 0:
                eta = np.concatenate([[v[0]], v[1] + x @ v[2:]])
                total += eta[y] - np.log(np.exp(eta).sum())
        return total

    best = objective(w)
    assert fit["objective"] == pytest.approx(best, abs=1e-4)
    assert all(objective(w + d) < best for d in 0.05 * np.vstack([np.eye(4), -np.eye(4)]))


def test_labelling_round_moves_priors_and_weights(spark):
    rng = np.random.default_rng(9)
    rows, truth = [], {}
    for p in range(120):
        x = rng.normal(size=3)
        y = int(np.argmax([0.3, *(1.5 * x + rng.gumbel(size=3) * 0.5)]))
        truth[p] = y
        rows.append((p, 0, 0, None, None, None))
        rows += [(p, i + 1, 0, 10 + (p + i) % 5, False, float(a)) for i, a in enumerate(x)]
    slots = spark.createDataFrame(rows, "peak_id long, slot int, species long, compound_id long, is_decoy boolean, x double")
    answer = lambda ps: spark.createDataFrame([(p, 0, truth[p], 10 + (p + truth[p] - 1) % 5 if truth[p] else None) for p in ps], "peak_id long, species long, label int, compound_id long")
    known = answer(range(30))
    prior, null = PR.batch_update(known)
    first = L.fit_round(slots, known.select("peak_id", "label"), prior, null, ["x"])
    batch = answer([25, 40, 41, 42, 43, 44])  # one of them has a label already
    second = L.labelling_round(slots, first, batch, ["x"])
    assert {r["peak_id"] for r in second.labels.collect()} == {*range(30), 40, 41, 42, 43, 44}
    fresh = [40, 41, 42, 43, 44]
    chosen = [p for p in fresh if truth[p]]
    total = lambda s: tuple(s.prior.agg(F.sum(F.col("alpha") - 1), F.sum(F.col("beta") - 1)).first())
    (a0, b0), (a1, b1) = total(first), total(second)
    assert a1 - a0 == len(chosen) and b1 - b0 == pytest.approx(0.25 * 2 * len(chosen))
    n0, n1 = first.null.first(), second.null.first()
    assert n1["alpha_null"] - n0["alpha_null"] == len(fresh) - len(chosen) and n1["beta_null"] - n0["beta_null"] == len(chosen)
    # the same optimum from the last weights and from nothing, in no more steps
    cold = A.fit_weights(second.train, ["x"])
    assert second.fit["converged"] and second.fit["theta"]["x"] == pytest.approx(cold["theta"]["x"], abs=1e-5)
    assert second.fit["iterations"] <= cold["iterations"] and second.fit["theta"] != first.fit["theta"]
    assert second.probs.groupBy("peak_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    # an answer that repeats what is known changes nothing
    again = L.labelling_round(slots, second, batch, ["x"])
    assert total(again) == total(second) and again.fit["theta"]["x"] == pytest.approx(second.fit["theta"]["x"], abs=1e-6)


def test_complexity(spark):
    peaks = spark.createDataFrame([(0, 100.0, 5.0), (1, 200.0, 5.0), (2, 300.0, 5.0)], "peak_id long, mass double, rt double")
    lib = spark.createDataFrame([(0, 100.004, 5.1, 0.1), (1, 99.995, 5.0, 0.1), (2, 100.02, 5.0, 0.1), (3, 200.0, 5.3, 0.1)],
                                "compound_id long, mass double, rt_mean double, rt_std double")
    counts = C.complexity(peaks, lib, 0.01)
    assert {r["peak_id"]: r["n_candidates"] for r in counts.collect()} == {0: 2, 1: 0, 2: 0}
    s = C.complexity_stats(counts).first()
    assert (s["median_candidates"], s["peaks_with_0"], s["peaks_with_2plus"], s["max_candidates"]) == (0.0, 2, 1, 2)


def test_curation(spark):
    rows = [(1, t, 5, 10 * t + i, 5.0 - 0.05 + d, 5.0, 0.2) for t in range(5) for i, d in enumerate((0.0, 0.09))]
    rows.append((1, 9, 5, 99, 5.5, 5.0, 0.2))  # outside the window
    df = spark.createDataFrame(rows, "sample_set_id long, task_id long, compound_id long, peak_id long, rt double, rt_mean double, half_width double")
    got = U.select_peaks(df, buffer=0.05).collect()
    deltas = [5.0 - r[4] for r in rows[:-1]]
    cf = float(np.median(deltas))
    assert {r["task_id"] for r in got} == set(range(5)) and all(r["correction"] == pytest.approx(cf) for r in got)
    assert U.select_peaks(df, buffer=0.02).count() == 0


def test_coherence_mixture_separates_two_populations(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, n in ((1, 300), (2, 60)):
        good = rng.random(n) < 0.8
        x = np.where(good, rng.normal(3, 0.5, n), rng.normal(-2, 1.0, n))
        rows += [(s, i, float(v), bool(g)) for i, (v, g) in enumerate(zip(x, good))]
    df = spark.createDataFrame(rows, "sample_set_id long, compound_id long, x double, good boolean")
    mix = U.coherence_mixture(df.select("sample_set_id", "compound_id", "x"))
    params = [c for c in mix.columns if c in ("mu0", "mu1", "var0", "var1", "w0", "w1")]
    by_sums = U.coherence_mixture(df.select("sample_set_id", "compound_id", "x"), iterations=30, tolerance=0.0, set_rows=0)
    in_task = U.coherence_mixture(df.select("sample_set_id", "compound_id", "x"), iterations=30, tolerance=0.0)
    at = lambda m: sorted((r["sample_set_id"], r["compound_id"], r["converged"], *[round(r[c], 8) for c in params]) for r in m.collect())
    assert at(by_sums) == at(in_task) and len(params) == 6
    wrong = mix.join(df, ["sample_set_id", "compound_id"]).where(F.col("rejected") == F.col("good")).count()
    assert wrong <= 0.03 * len(rows)
    means = {r["sample_set_id"]: r for r in mix.select("sample_set_id", "mu0", "mu1", "w1").distinct().collect()}
    assert means[1]["mu1"] == pytest.approx(3, abs=0.15) and means[1]["mu0"] == pytest.approx(-2, abs=0.4)
    kept = U.drop_incoherent(mix.select("sample_set_id", "compound_id"), mix)
    assert kept.count() == mix.where("NOT rejected").count()


def test_label_runs_are_merged_and_replays_count_once(spark, tmp_path):
    from peakloom.streaming import monitor as W

    cand = spark.createDataFrame([(p, 10 + (p + i) % 4) for p in range(40) for i in range(3)], "peak_id long, compound_id long")
    batches = [[(p, p % 2, None if p % 5 == 0 else 10 + p % 4) for p in range(4 * b, 4 * b + 4)] for b in range(10)]
    frame = lambda rows: spark.createDataFrame(rows, "peak_id long, species long, compound_id long")
    path = str(tmp_path / "runs")
    key = lambda df: sorted(map(tuple, df.select("species", "compound_id", "d_alpha", "d_beta").collect()), key=repr)
    for b, rows in enumerate(batches):
        W.fold_labels(frame(rows), b, cand, path, merge_every=3)
        so_far = [r for done in batches[: b + 1] for r in done]
        assert key(W.prior_increments(spark, path)) == key(PR.label_events(frame(so_far), cand))
    runs = W._runs(spark, path)
    assert runs == [(0, 8), (9, 9)] and len(list((tmp_path / "runs").iterdir())) == 2
    # batches that come again, one inside a merged run, and a run left behind by a failure
    want = key(W.prior_increments(spark, path))
    W.fold_labels(frame(batches[9]), 9, cand, path, merge_every=3)
    W.fold_labels(frame(batches[8]), 8, cand, path, merge_every=3)
    PR.label_events(frame(batches[7]), cand).write.parquet(W._run_path(path, 7, 7))
    assert key(W.prior_increments(spark, path)) == want


def test_median_shift_needs_no_table_and_equals_the_ordered_scan(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(t), int(c), i, float(np.round(5 + rng.normal(0, 0.02), 3)), 5.0, 0.15) for i, (s, t, c) in enumerate(rng.integers(0, 4, (600, 3)))]
    rows += [(None, 0, 0, 900, 5.0, 5.0, 0.15), (0, 0, None, 901, 5.0, 5.0, 0.15), (9, 0, 0, 902, None, 5.0, 0.15)]
    peaks = spark.createDataFrame(rows, "sample_set_id long, task_id long, compound_id long, peak_id long, rt double, rt_mean double, half_width double")
    monkeypatch.setattr(U, "GROUP_ROWS", 0)
    scanned = U.select_peaks(peaks)
    want = sorted(map(tuple, scanned.collect()))
    monkeypatch.setattr(U, "GROUP_ROWS", 200_000)
    monkeypatch.setattr(U, "stored", lambda df: pytest.fail("groups of a few rows are dealt once"))
    got = U.select_peaks(peaks)
    assert got.columns == scanned.columns and sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_only_cells_with_a_large_share_are_salted(spark, monkeypatch):
    joined, seen = X.lookup_join, []

    def watch(facts, dim, on, how="left", hot=None, **rest):
        if hot is not None:
            seen.append(hot.count())
        return joined(facts, dim, on, how, hot, **rest)

    # 300 pairs at the sodium shift, each in cells of its own
    points = [(2 * i + j, 0, 200.0 + i + j * 21.9819, 5.0 + (i % 7), 10.0 + i + j) for i in range(300) for j in (0, 1)]
    peaks = spark.createDataFrame(points, "peak_id long, species long, mass double, rt double, intensity double")
    want = sorted(map(tuple, X.partner_features(peaks).collect()))
    counts = sorted(map(tuple, X.pair_counts(peaks).collect()))
    monkeypatch.setattr(X, "lookup_join", watch)
    monkeypatch.setattr(X, "CROWDED_BYTES", -1, raising=False)
    assert sorted(map(tuple, X.partner_features(peaks, cell_points=0).collect())) == want
    assert sorted(map(tuple, X.pair_counts(peaks, cell_points=0).collect())) == counts
    assert seen and max(seen) <= 256
