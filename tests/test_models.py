"""Solvers against dense algebra, recovery of known parameters, fallbacks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakloom.functions import values as V
from peakloom.operators import lasso as LA
from peakloom.operators import metrics as M
from peakloom.operators import pooling as PO
from peakloom.operators import ridge as R
from peakloom.operators import scoring as SC
from peakloom.operators import sums as S


@pytest.fixture(scope="module")
def rows3(spark):
    rng = np.random.default_rng(42)
    n = 300
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["IS1", "IS2", "RS1"])
    pdf["species_cluster"] = rng.integers(0, 3, n)
    pdf["comp_id"] = rng.integers(0, 4, n)
    pdf["rt"] = 0.4 + 0.5 * pdf["IS1"] - 1.2 * pdf["IS2"] + 0.3 * pdf["RS1"] + 0.01 * rng.normal(size=n)
    return spark.createDataFrame(pdf), pdf


KEYS, FEATURES = ["species_cluster", "comp_id"], ["IS1", "IS2", "RS1"]


def test_ridge_recovers_slopes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [0.5, -1.2, 0.3] - 0.7 + 0.01 * rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "rt": y, "IS1": x[:, 0], "IS2": x[:, 1], "RS1": x[:, 2]}))
    row = R.ridge(S.centred(S.group_sums(df, ["g"], FEATURES)), ["g"], 3, 1e-6).first()
    assert np.abs(np.array(row["coef"]) - [0.5, -1.2, 0.3]).max() < 0.05
    assert row["intercept"] == pytest.approx(-0.7, abs=0.05) and row["sigma"] < 0.1


def test_group_posterior_equals_dense_solution(rows3):
    df, pdf = rows3
    lam, s2 = 0.3, 0.04
    got = R.group_posterior(S.centred(S.group_sums(df, KEYS, FEATURES)), KEYS, 3, lam, s2)
    for r in got.collect():
        part = pdf[(pdf["species_cluster"] == r["species_cluster"]) & (pdf["comp_id"] == r["comp_id"])]
        x = np.column_stack([np.ones(len(part)), part[FEATURES]])
        a = x.T @ x + np.diag([0, lam, lam, lam])
        assert np.allclose(r["beta_hat"], np.linalg.solve(a, x.T @ part["rt"]), atol=1e-8)
        assert np.allclose(np.reshape(r["beta_cov"], (4, 4)), s2 * np.linalg.inv(a), atol=1e-10)


@pytest.mark.parametrize("tau", [0.2, 1e4])
def test_intercept_prior_equals_dense_solution(rows3, tau):
    df, pdf = rows3
    lam, s2 = 0.3, 0.04
    stats = S.centred(S.group_sums(df, KEYS, FEATURES)).withColumns({"mb": F.lit(1.5), "mw": F.array(*[F.lit(v) for v in (0.1, -0.2, 0.3)])})
    got = R.group_posterior_with_prior(stats, KEYS, 3, lam, s2, tau, "mb", "mw").collect()
    flat = {(r[0], r[1]): r for r in R.group_posterior(stats, KEYS, 3, lam, s2, "mw").collect()}
    prior = np.array([1.5, 0.1, -0.2, 0.3])
    precision = np.diag([s2 / tau**2, lam, lam, lam])
    for r in got:
        part = pdf[(pdf["species_cluster"] == r["species_cluster"]) & (pdf["comp_id"] == r["comp_id"])]
        x = np.column_stack([np.ones(len(part)), part[FEATURES]])
        want = np.linalg.solve(x.T @ x + precision, x.T @ part["rt"] + precision @ prior)
        assert np.allclose(r["beta_hat"], want, atol=1e-8)
        if tau > 1e3:
            assert np.allclose(r["beta_hat"], flat[(r[0], r[1])]["beta_hat"], atol=1e-6)


def test_wide_designs_use_the_matrix_path(spark):
    rng = np.random.default_rng(5)
    p, n = 14, 400
    x = rng.normal(size=(n, p))
    names = [f"IS{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=names).assign(g=rng.integers(0, 3, n), rt=x @ rng.normal(size=p))
    df = spark.createDataFrame(pdf).repartition(5)
    assert p > S.SQL_FEATURES
    for r in S.group_sums(df, ["g"], names).collect():
        part = pdf[pdf["g"] == r["g"]]
        xg = part[names].to_numpy()
        assert r["n"] == len(part)
        assert np.allclose(np.reshape(r["sum_xx"], (p, p)), xg.T @ xg) and np.allclose(r["sum_xy"], xg.T @ part["rt"])
    coef = R.group_posterior(S.centred(S.group_sums(df.withColumn("comp_id", F.lit(1)), ["g", "comp_id"], names)), ["g", "comp_id"], p, 1e-6)
    scored = SC.score(df.withColumn("comp_id", F.lit(1)), coef, names, "g")
    out = scored.toPandas()
    cov = {r["g"]: np.reshape(r["beta_cov"], (p + 1, p + 1)) for r in coef.collect()}
    assert np.abs(out["err"]).max() < 1e-4
    r = out.iloc[0]
    x1 = np.concatenate([[1.0], r[names].to_numpy(float)])
    s2 = {c["g"]: c["sigma2_mean"] for c in coef.collect()}[r["g"]]
    assert r["pred_std"] ** 2 == pytest.approx(max(s2, 1e-12) + x1 @ cov[r["g"]] @ x1, rel=1e-6)


def test_scores_with_centre_and_rotation_equal_plain_scores(rows3):
    df, _ = rows3
    plain, s0 = R.train_groups(df, FEATURES, penalty=1e-9)
    turned, s1 = R.train_groups(df, FEATURES, penalty=1e-9, center="global", rotation="pca")
    a = SC.score(df, plain, FEATURES).agg(F.sum("pred_mean"), F.sum("pred_std")).first()
    b = SC.score(df, turned, FEATURES, center=s1["center"], rotation=s1["rotation"]).agg(F.sum("pred_mean"), F.sum("pred_std")).first()
    assert a[0] == pytest.approx(b[0], rel=1e-6) and a[1] == pytest.approx(b[1], rel=1e-5)


def test_shared_variance_is_the_maximum(rows3):
    df, _ = rows3
    res = R.residual_sums(S.centred(S.group_sums(df, KEYS, FEATURES)), KEYS, 3, 0.1)
    row = R.shared_variance(res).first()
    grid = np.exp(np.linspace(math.log(row["sigma2"]) - 1, math.log(row["sigma2"]) + 1, 20001))
    post = -0.5 * row["dof"] * np.log(grid) - row["sse"] / (2 * grid) - grid / (2 * 0.05**2)
    assert grid[post.argmax()] == pytest.approx(row["sigma2"], rel=1e-3)


def evaluation(spark, group):
    """Two groups of ten exact rows and one row of an unseen group."""
    a, b = (0, 1) if group == "species_cluster" else (101, 202)
    beta = {a: (0.3, 0.1, -0.05), b: (0.2, 0.05, 0.02)}
    rows = [
        (float(w[0] + w[1] * (5 + 0.1 * i) + w[2] * (10 - 0.2 * i)), g, 10, 5 + 0.1 * i, 10 - 0.2 * i)
        for g, w in beta.items() for i in range(10)
    ]
    rows.append((1.0, 9, 999, 5.0, 10.0))
    df = spark.createDataFrame(rows, f"rt double, {group} long, comp_id long, IS1 double, RS1 double")
    coef = spark.createDataFrame(
        [(g, 10, 10, [float(v) for v in w], [0.0] * 3, [0.0] * 9, 1e-12, i) for i, (g, w) in enumerate(beta.items())],
        f"{group} long, comp_id long, n long, beta_hat array<double>, beta_var_diag array<double>, beta_cov array<double>, sigma2_mean double, supercat_id long",
    )
    return df, coef


@pytest.mark.parametrize("group", ["species_cluster", "species"])
def test_evaluation_counts_unseen_groups(spark, group):
    df, coef = evaluation(spark, group)
    scored = SC.score(df, coef, ["IS1", "RS1"], group)
    m = M.overall(scored).first()
    assert (m["n_test"], m["n_used"], m["n_skipped"]) == (21, 20, 1) and m["rmse"] < 1e-6
    bins = M.by_support(scored, coef, group).collect()
    assert [(r["support_bin"], r["n_groups"], r["n_groups_with_test"]) for r in bins] == [("6-10", 2, 2)]
    with pytest.raises(ValueError, match="without coefficients"):
        SC.score(df, coef, ["IS1", "RS1"], group, require_seen=True)


def test_unknown_settings_are_rejected(rows3):
    df, _ = rows3
    with pytest.raises(ValueError, match="group column"):
        R.train_groups(df, FEATURES, group="vendor")
    with pytest.raises(ValueError, match="mode"):
        R.fit(df, FEATURES, "neural")
    with pytest.raises(ValueError, match="rotation"):
        R.train_groups(df, FEATURES, rotation="pca")
    with pytest.raises(ValueError, match="hierarchy"):
        R.fit(df, FEATURES, "group_ridge", compound_effects=True)


def test_fallback_model(spark):
    schema = "intercept double, coef array<double>, sigma double, sigma2_mean double, v_diag array<double>, x_mean array<double>, n long"
    fine = spark.createDataFrame([(1, 10, 0.0, [1.0, 0.0], 0.1, 0.01, [0.1, 0.1], [0.0, 0.0], 4)], "supercategory long, comp_id long, " + schema)
    coarse = spark.createDataFrame([(20, 0.0, [0.0, 1.0], 0.2, 0.04, [0.1, 0.1], [0.0, 0.0], 8)], "comp_id long, " + schema)
    rows = spark.createDataFrame([(1, 10, 2.0, 3.0), (2, 20, 2.0, 3.0), (2, 30, 2.0, 3.0)], "supercategory long, comp_id long, IS1 double, RS1 double")
    got = {r["comp_id"]: r for r in SC.predict_two_level(rows, fine, coarse, ["IS1", "RS1"]).collect()}
    assert (got[10]["pred_mean"], got[10]["pred_std"], got[10]["used_fallback"]) == (2.0, 0.1, False)
    assert (got[20]["pred_mean"], got[20]["pred_std"], got[20]["used_fallback"]) == (3.0, 0.2, True)
    assert got[30]["pred_mean"] is None and not got[30]["matched"]
    post = {r["comp_id"]: r for r in SC.predict_posterior(rows, fine, coarse, ["IS1", "RS1"]).collect()}
    assert post[10]["pred_std"] == pytest.approx(math.sqrt(0.01 * (1 + 0.1 * 4 + 0.1 * 9 + 1 / 4)))
    assert post[20]["pred_df"] == 12


def test_derived_features():
    names = V.quadratic_names(["IS1", "RS1", "ES_1"])
    assert names == ["poly2_sq(IS1)", "poly2_sq(RS1)", "poly2_int(IS1,RS1)"]
    assert V.raw_inputs("poly2_int(IS1,RS1)") == ("IS1", "RS1")
    with pytest.raises(ValueError, match="missing columns"):
        V.feature_value("poly2_sq(IS9)", ["IS1"])
    assert V.support_labels() == ["<= 1", "2-2", "3-5", "6-10", "11-20", "21-50", "51-100", "> 100"]


def test_lasso_satisfies_its_optimality_conditions(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1]
    y = 1.0 + 0.8 * x[:, 0] - 0.4 * x[:, 1] + 0.05 * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["IS1", "IS2", "IS3", "IS4"]).assign(rt=y, g=1, rid=np.arange(n))
    m = LA.fit_lasso(spark.createDataFrame(pdf), ["g"], ["IS1", "IS2", "IS3", "IS4"], ["rid"]).first()
    sd = x.std(axis=0)
    xs, w = (x - x.mean(axis=0)) / sd, np.array(m["coef"]) * sd
    grad = xs.T @ (y - y.mean() - xs @ w) / n
    active = np.abs(w) > 1e-9
    assert np.allclose(grad[active], m["alpha"] * np.sign(w[active]), atol=1e-7)
    assert np.all(np.abs(grad[~active]) <= m["alpha"] + 1e-7)
    assert np.abs(np.array(m["coef"])[:2] - [0.8, -0.4]).max() < 0.05


def test_lasso_skips_small_groups(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1), (1, 2.0, 2.0, 2), (2, 1.0, 1.0, 3), (2, 2.0, 1.5, 4), (2, 3.0, 2.5, 5)], "g long, IS1 double, rt double, rid long")
    m = LA.fit_lasso(df, ["g"], ["IS1"], ["rid"])
    assert [r["g"] for r in m.collect()] == [2]
    assert m.first()["alpha"] == LA.SMALL_GROUP_ALPHA
    pred = LA.predict_lasso(df, m, ["g"], ["IS1"])
    assert pred.where("pred_mean IS NULL").count() == 2


def test_partial_pooling_beats_separate_fits_on_sparse_groups(spark):
    rng = np.random.default_rng(7)
    ns, nc, p = 24, 40, 2
    mu, al = rng.normal(0, 0.2, ns), rng.normal(0, 0.3, nc)
    head = np.array([0.2, -0.1]) + rng.normal(0, 0.05, (ns, p))
    rows, test = [], []
    for s in range(ns):
        for c in range(nc):
            b = 4 + mu[s] + al[c] + rng.normal(0, 0.1)
            w = head[s] + rng.normal(0, 0.01, p)
            for i in range(int(rng.integers(1, 8)) + 2):
                x = rng.normal(size=p)
                (test if i < 2 else rows).append((s, s % 4, c, *x, b + x @ w + rng.normal(0, 0.03)))
    cols = ["species", "species_cluster", "comp_id", "IS1", "RS1", "rt"]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=cols)).persist()
    held = spark.createDataFrame(pd.DataFrame(test, columns=cols)).persist()
    coef, state = PO.train_partial_pool(df, ["IS1", "RS1"], penalty=9.0, rounds=12, tolerance=1e-6)
    assert math.sqrt(state.sigma2) == pytest.approx(0.03, rel=0.35)
    assert math.sqrt(state.tau_b2) == pytest.approx(0.1, rel=0.3)
    pooled = M.overall(SC.score(held, coef, ["IS1", "RS1"], "species", center=state.center)).first()["rmse"]
    for penalty in (1e-3, 1.0):
        alone, _ = R.train_groups(df, ["IS1", "RS1"], "species", penalty)
        single = M.overall(SC.score(held, alone, ["IS1", "RS1"], "species")).first()["rmse"]
        assert pooled < 0.6 * single
    far = held.withColumns({f: F.col(f) - F.lit(c) for f, c in zip(state.features, state.center)})
    back = SC.score_backoff(far, *state.backoff()[:2], state.features, state.t0)
    rmse = back.select(F.sqrt(F.avg((F.col("pred_mean") - F.col("rt")) ** 2))).first()[0]
    assert rmse < 0.2
    # a species that was never seen takes its cluster's effect, an unknown cluster nothing
    strange = far.where("species IN (0, 1)").withColumn("species_cluster", F.when(F.col("species") == 1, 99).otherwise(F.col("species_cluster"))).withColumn("species", F.col("species") + 1000)
    back = SC.score_backoff(strange, *state.backoff()[:2], state.features, state.t0, clusters=state.cluster_effects())
    effects = {r["species_cluster"]: r for r in state.cluster_effects().collect()}
    alpha = {r["comp_id"]: r["alpha"] for r in state.compounds.collect()}
    for r in back.collect():
        assert r["effect_of"] == ("cluster" if r["species"] == 1000 else "none")
        e = effects.get(r["species_cluster"])
        want = state.t0 + alpha[r["comp_id"]] + (e["mu"] + e["slopes"][0] * r["IS1"] + e["slopes"][1] * r["RS1"] if e else 0.0)
        assert r["pred_mean"] == pytest.approx(want)
    df.unpersist(), held.unpersist()


def test_partial_pooling_uses_embeddings(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(30, 2))
    rows = [
        (s, s % 2, c, float(x), float(3 + z[c] @ [0.5, -0.3] + 0.1 * x + rng.normal(0, 0.02)))
        for s in range(6) for c in range(30) for x in rng.normal(size=3)
    ]
    df = spark.createDataFrame(rows, "species long, species_cluster long, comp_id long, IS1 double, rt double")
    emb = spark.createDataFrame([(c, [float(v) for v in z[c]]) for c in range(30)], "comp_id long, z array<double>")
    _, state = PO.train_partial_pool(df, ["IS1"], emb, rounds=6)
    assert np.allclose(state.theta, [0.5, -0.3], atol=0.1)


def test_run_metadata_rejects_contradictions(spark):
    good = spark.createDataFrame([(0, 1, 2.0), (0, 1, 2.0), (1, 1, 3.0)], "run long, species long, run_covariate_0 double")
    assert S.run_metadata(good, "run").count() == 2
    bad = spark.createDataFrame([(0, 1, 2.0), (0, 1, 2.5)], "run long, species long, run_covariate_0 double")
    with pytest.raises(ValueError, match="inconsistent"):
        S.run_metadata(bad, "run")
    with pytest.raises(ValueError, match="missing"):
        S.run_metadata(good, "run", ["absent"])
    mixed = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "run long, species long, IS1 double")
    with pytest.raises(ValueError, match="several species"):
        S.require_single_owner(S.run_means(mixed, ["run"], ["IS1"]))


def test_clusters_and_components(spark):
    from peakloom.operators import embeddings as E

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (40, 6)), rng.normal(8, 1, (40, 6))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chem_id long, embedding array<double>")
    labels, cost = E.chemical_classes(df, "embedding", 2)
    got = {r["chem_id"]: r["compound_class"] for r in labels.collect()}
    assert len({got[i] for i in range(40)}) == 1 and got[0] != got[79] and cost > 0
    w = np.array([r["embedding20"] for r in E.whitened_components(df, "embedding", 3).orderBy("chem_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(w), np.abs(u[:, :3] * math.sqrt(len(x) - 1)), atol=1e-6)
    runs = spark.createDataFrame([(s, float(10 * (s % 2)), float(s % 2)) for s in range(6)], "species long, IS1 double, IS2 double")
    clusters = {r["species"]: r["cluster"] for r in E.species_clusters(runs, ["IS1", "IS2"], 2).collect()}
    assert clusters[0] == clusters[2] == clusters[4] != clusters[1]
    assert E.species_clusters(runs, ["IS1"], 99).select("cluster").distinct().count() <= 6


# -- missing targets, digits, wide designs ---------------------------------------------------------


@pytest.mark.parametrize("p", [1, 10, 11])
def test_missing_targets_are_refused_or_left_out(spark, p):
    names = [f"IS{i + 1}" for i in range(p)]
    rng = np.random.default_rng(p)
    x = np.round(rng.normal(size=(40, p)), 3)
    y = 10.0 + x[:, 0]
    target = [None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(v) for i, v in enumerate(y)]
    rows = [(i % 2, *map(float, r), t) for i, (r, t) in enumerate(zip(x, target))] + [(7, *map(float, x[0]), None)]
    df = spark.createDataFrame(rows, "g long, " + ", ".join(f"{n} double" for n in names) + ", rt double")
    with pytest.raises(Exception, match="null or not finite"):
        S.group_sums(df, ["g"], names).collect()
    got = {r["g"]: r for r in S.group_sums(df, ["g"], names, missing="skip").collect()}
    assert got[7]["n"] == 0 and got[7]["n_left_out"] == 1 and got[7]["sum_xx"] == [0.0] * p * p
    for g in (0, 1):
        use = np.array([i % 2 == g and i % 4 > 1 for i in range(40)])
        assert (got[g]["n"], got[g]["n_left_out"]) == (use.sum(), 20 - use.sum())
        assert np.allclose(got[g]["sum_xx"], (x[use].T @ x[use]).ravel()) and np.allclose(got[g]["sum_xy"], x[use].T @ y[use])
    assert {r["g"] for r in S.centred(S.group_sums(df, ["g"], names, missing="skip")).collect()} == {0, 1}


def test_far_from_zero_gives_the_same_model(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=200), 6)
    y = np.round(0.3 * x + rng.normal(size=200) * 0.01, 9)
    near, far = (
        spark.createDataFrame([(int(i % 2), 1, float(a + s), float(b + s)) for i, (a, b) in enumerate(zip(x, y))], "supercategory long, comp_id long, IS1 double, rt double")
        for s in (0.0, 1e6)
    )
    for a, b in zip(R.train_two_grain(near, ["IS1"], 1e-3), R.train_two_grain(far, ["IS1"], 1e-3)):
        keys = [c for c in ("supercategory", "comp_id") if c in a.columns]
        a, b = ({tuple(r[k] for k in keys): r for r in t.collect()} for t in (a, b))
        for k in a:
            assert b[k]["coef"][0] == pytest.approx(a[k]["coef"][0], abs=1e-6)
            assert b[k]["sigma"] == pytest.approx(a[k]["sigma"], rel=1e-4)


def test_wide_designs_keep_plans_small(spark):
    names = [f"IS{i + 1}" for i in range(65)]
    df = spark.range(50).selectExpr("id % 3 AS g", "id % 2 AS h", *[f"cast((id * {i + 3}) % 11 AS double) AS {n}" for i, n in enumerate(names)], "cast(id AS double) AS rt")
    fine, coarse = S.two_grains(df, ["g", "h"], ["h"], names)
    plan = coarse._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") < 100
    pdf = df.toPandas()
    for r in coarse.collect():
        part = pdf[pdf["h"] == r["h"]]
        m = part[names].to_numpy(float)
        assert r["n"] == len(part) and np.allclose(r["sum_xx"], (m.T @ m).ravel()) and np.allclose(r["sum_xy"], m.T @ part["rt"].to_numpy(float))
