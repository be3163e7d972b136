"""Catalogue queries: grouped models and their scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.aggregates import BIN_SQL, RATIOS
from peakloom.catalog.inputs import kept, table, view, with_views
from peakloom.catalog.preparation import fraction_sql
from peakloom.catalog.registry import ORACLES, query, rounded
from peakloom.catalog.storage import BUNDLE_SQL, _bundle, _stored
from peakloom.functions import values as V
from peakloom.operators import metrics as M
from peakloom.operators import preparation as P
from peakloom.operators import ridge as R
from peakloom.operators import scoring as SC
from peakloom.operators import sums as S
from peakloom.plans.durable import stored
from peakloom.sources import scans, sinks

FEATURES = ["IS1", "RS1", "ES_1"]
LAMBDA = 1e-3


def _fold(spark, sf, fold):
    return view(spark, sf, "obs").where(F.col("fold") == fold)


def flagship(spark, sf):
    """Train per-group ridge on the training fold, score the held-out fold, report by support."""
    coef, settings = R.train_groups(_fold(spark, sf, "train"), FEATURES, "species", LAMBDA, center="global")
    coef = stored(coef)
    scored = SC.score(
        _fold(spark, sf, "test"), coef, FEATURES, "species", center=settings["center"], rotation=settings["rotation"]
    )
    return rounded(M.by_support(scored, coef, "species"))


# One covariate in plain SQL: sums, slope, intercept, noise, covariance.
FIT = f""", tr AS (SELECT * FROM obs WHERE fold = 'train'),
  s AS (SELECT {{keys}}, count(*) AS n, avg(IS1) AS xm, avg(rt) AS ym, sum(IS1*IS1) - count(*)*avg(IS1)*avg(IS1) AS sxx,
    sum(IS1*rt) - count(*)*avg(IS1)*avg(rt) AS sxy, sum(rt*rt) - count(*)*avg(rt)*avg(rt) AS syy FROM tr GROUP BY {{keys}}),
  f AS (SELECT *, sxy / (sxx + {LAMBDA:e}) AS w, ym - xm * sxy / (sxx + {LAMBDA:e}) AS b FROM s),
  m AS (SELECT *, sqrt(greatest(syy - 2*w*sxy + w*w*sxx, 0) / n) AS sigma,
    (1e-6 + 5e-1*greatest(syy - w*sxy, 0)) / (1e0 + n/2e0) AS s2, 1/(sxx + {LAMBDA:e}) AS v,
    greatest(syy - sxy*sxy/(sxx + {LAMBDA:e}), 0) AS sse FROM f)"""


def _stats(spark, sf, keys, features=("IS1",)):
    return S.centred(S.group_sums(_fold(spark, sf, "train"), keys, list(features)))


first = lambda c: F.get(c, F.lit(0))


@query(
    "M1_ridge",
    with_views(FIT.format(keys="species, comp_id") + " SELECT species, comp_id, n, round(b, 6) AS intercept, round(w, 6) AS slope, round(sigma, 6) AS sigma FROM m", "obs"),
)
def _(spark, sf):
    m = R.ridge(_stats(spark, sf, ["species", "comp_id"]), ["species", "comp_id"], 1, LAMBDA)
    return rounded(m.select("species", "comp_id", "n", "intercept", first("coef").alias("slope"), "sigma"))


@query(
    "M2_bayesian_ridge",
    with_views(
        FIT.format(keys="species, comp_id") + """ SELECT species, comp_id, n, round(b, 6) AS intercept, round(w, 6) AS slope, round(sigma, 6) AS sigma,
        round(s2, 8) AS sigma2_mean, round(v, 8) AS v, round(xm, 6) AS x_mean FROM m""",
        "obs",
    ),
)
def _(spark, sf):
    m = R.bayesian_ridge(_stats(spark, sf, ["species", "comp_id"]), ["species", "comp_id"], 1, LAMBDA)
    return m.select(
        "species", "comp_id", "n", F.round("intercept", 6).alias("intercept"), F.round(first("coef"), 6).alias("slope"),
        F.round("sigma", 6).alias("sigma"), F.round("sigma2_mean", 8).alias("sigma2_mean"), F.round(first("v_diag"), 8).alias("v"),
        F.round(first("x_mean"), 6).alias("x_mean"),
    )


def _two_grain(spark, sf):
    rows = _fold(spark, sf, "train").withColumnRenamed("species_cluster", "supercategory")
    return tuple(stored(t) for t in R.train_two_grain(rows, ["IS1"], LAMBDA))


@query(
    "M3_two_grain_model",
    with_views(
        FIT.format(keys="species_cluster, comp_id")
        + f""", s2_ AS (SELECT comp_id, count(*) AS n, avg(IS1) AS xm, avg(rt) AS ym, sum(IS1*IS1) - count(*)*avg(IS1)*avg(IS1) AS sxx,
            sum(IS1*rt) - count(*)*avg(IS1)*avg(rt) AS sxy FROM tr GROUP BY 1)
        SELECT species_cluster AS supercategory, comp_id, n, round(w, 6) AS slope, round(b, 6) AS intercept FROM m
        UNION ALL SELECT NULL, comp_id, n, round(sxy/(sxx + {LAMBDA:e}), 6), round(ym - xm*sxy/(sxx + {LAMBDA:e}), 6) FROM s2_""",
        "obs",
    ),
)
def _(spark, sf):
    fine, coarse = _two_grain(spark, sf)
    both = fine.unionByName(coarse, allowMissingColumns=True)
    return rounded(both.select("supercategory", "comp_id", "n", first("coef").alias("slope"), "intercept"))


TWO_LEVEL = FIT.format(keys="species_cluster, comp_id") + f""", cs AS (SELECT comp_id, count(*) AS n, avg(IS1) AS xm, avg(rt) AS ym,
    sum(IS1*IS1) - count(*)*avg(IS1)*avg(IS1) AS sxx, sum(IS1*rt) - count(*)*avg(IS1)*avg(rt) AS sxy, sum(rt*rt) - count(*)*avg(rt)*avg(rt) AS syy FROM tr GROUP BY 1),
  c AS (SELECT comp_id, n, xm, sxy/(sxx + {LAMBDA:e}) AS w, ym - xm*sxy/(sxx + {LAMBDA:e}) AS b,
    sqrt(greatest(syy - 2*sxy/(sxx + {LAMBDA:e})*sxy + sxy/(sxx + {LAMBDA:e})*sxy/(sxx + {LAMBDA:e})*sxx, 0) / n) AS sigma,
    (1e-6 + 5e-1*greatest(syy - sxy/(sxx + {LAMBDA:e})*sxy, 0)) / (1e0 + n/2e0) AS s2, 1/(sxx + {LAMBDA:e}) AS v FROM cs),
  te AS (SELECT *, CASE WHEN RS1 < 2e-2 THEN 99 ELSE species_cluster END AS sc FROM obs WHERE fold = 'test'),
  j AS (SELECT te.*, m.b IS NULL AS used_fallback, coalesce(m.b, c.b) AS b, coalesce(m.w, c.w) AS w, coalesce(m.sigma, c.sigma) AS sigma,
    coalesce(m.n, c.n) AS n, coalesce(m.xm, c.xm) AS xm, coalesce(m.s2, c.s2) AS s2, coalesce(m.v, c.v) AS v
    FROM te LEFT JOIN m ON te.sc = m.species_cluster AND te.comp_id = m.comp_id LEFT JOIN c ON te.comp_id = c.comp_id)"""


def _two_level_rows(spark, sf):
    """Test rows; those with a low reading carry a group number the model has not seen."""
    return _fold(spark, sf, "test").withColumn(
        "supercategory", F.when(F.col("RS1") < 0.02, F.lit(99).cast("long")).otherwise(F.col("species_cluster"))
    )


@query(
    "M4_predict_with_fallback",
    with_views(
        TWO_LEVEL + """ SELECT comp_id, used_fallback, count(*) AS n_rows, round(avg(b + w*IS1), 6) AS mean_pred, round(avg(sigma), 6) AS mean_std FROM j GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    pred = SC.predict_two_level(_two_level_rows(spark, sf), *_two_grain(spark, sf), ["IS1"])
    return rounded(
        pred.groupBy("comp_id", "used_fallback").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg("pred_mean").alias("mean_pred"), F.avg("pred_std").alias("mean_std"))
    )


@query(
    "J8_two_level_lookup",
    with_views(TWO_LEVEL + " SELECT sc AS supercategory, used_fallback, count(*) AS n_rows FROM j GROUP BY 1, 2", "obs"),
)
def _(spark, sf):
    pred = SC.predict_two_level(_two_level_rows(spark, sf), *_two_grain(spark, sf), ["IS1"])
    return pred.groupBy("supercategory", "used_fallback").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "M5_posterior_predictive",
    with_views(
        TWO_LEVEL + """ SELECT comp_id, used_fallback, round(avg(b + w*IS1), 6) AS mean_pred, round(avg(sqrt(s2*(1 + (IS1 - xm)*(IS1 - xm)*v + 1e0/n))), 6) AS mean_std,
        round(max(n + 4e0), 6) AS max_df FROM j GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    pred = SC.predict_posterior(_two_level_rows(spark, sf), *_two_grain(spark, sf), ["IS1"])
    return rounded(
        pred.groupBy("comp_id", "used_fallback").agg(
            F.avg("pred_mean").alias("mean_pred"), F.avg("pred_std").alias("mean_std"), F.max("pred_df").alias("max_df"))
    )


@query(
    "M6_group_posterior",
    with_views(
        FIT.format(keys="species, comp_id") + """ SELECT species, comp_id, n, round(b, 6) AS b, round(w, 6) AS w, round(s2*(1e0/n + xm*xm*v), 8) AS var_b,
        round(-s2*v*xm, 8) AS cov_bw, round(s2*v, 8) AS var_w FROM m""",
        "obs",
    ),
)
def _(spark, sf):
    m = R.group_posterior(_stats(spark, sf, ["species", "comp_id"]), ["species", "comp_id"], 1, LAMBDA)
    at = lambda c, i, d, a: F.round(F.get(c, F.lit(i)), d).alias(a)
    return m.select(
        "species", "comp_id", "n", at("beta_hat", 0, 6, "b"), at("beta_hat", 1, 6, "w"), at("beta_cov", 0, 8, "var_b"),
        at("beta_cov", 1, 8, "cov_bw"), at("beta_cov", 3, 8, "var_w"),
    )


@query(
    "M7_posterior_with_intercept_prior",
    with_views(
        FIT.format(keys="species, comp_id") + f""", u AS (SELECT species, comp_id, n, n + 4e-2 AS a11, n*xm AS a12, sxx + n*xm*xm + {LAMBDA:e} + 1e-12 AS a22,
            n*ym + 4e-2*3e0 AS r1, sxy + n*xm*ym AS r2 FROM m)
        SELECT species, comp_id, n, round((a22*r1 - a12*r2)/(a11*a22 - a12*a12), 6) AS b, round((a11*r2 - a12*r1)/(a11*a22 - a12*a12), 6) AS w,
          round(1e-4*a22/(a11*a22 - a12*a12), 8) AS var_b FROM u""",
        "obs",
    ),
)
def _(spark, sf):
    stats = _stats(spark, sf, ["species", "comp_id"]).withColumn("prior_b", F.lit(3.0))
    m = R.group_posterior_with_prior(stats, ["species", "comp_id"], 1, LAMBDA, 1e-4, 0.05, "prior_b")
    at = lambda c, i, d, a: F.round(F.get(c, F.lit(i)), d).alias(a)
    return m.select("species", "comp_id", "n", at("beta_hat", 0, 6, "b"), at("beta_hat", 1, 6, "w"), at("beta_cov", 0, 8, "var_b"))


@query(
    "M8_group_trainer",
    with_views(
        f""" SELECT species, comp_id, count(*) AS n, CAST(7 AS INTEGER) AS n_coef, 0e0 AS residual FROM obs
        WHERE fold = 'train' AND species_cluster <> 4 AND {fraction_sql(["species", "comp_id"], 42)} >= 1e-1 GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    """Held-out compounds and clusters removed, degree-2 anchors with their own penalty. The largest
    gradient of each group's posterior, worked out from its rows, is zero at the optimum."""
    rows = P.exclude_clusters(_fold(spark, sf, "train"), [4])
    rows = P.hold_out(rows, ["species", "comp_id"], 0.1, 42)
    names = FEATURES + V.quadratic_names(FEATURES)
    penalties = R.poly2_penalties(names, LAMBDA, 1e-2)
    coef, settings = R.train_groups(rows, names, "species", penalties, center="global")
    x = [V.feature_value(f, rows.columns) - F.lit(c) for f, c in zip(names, settings["center"])]
    at = lambda i: F.get("beta_hat", F.lit(i))
    wide = rows.select("species", "comp_id", "rt", *[v.alias(f"x{i}") for i, v in enumerate(x)]).join(coef.select("species", "comp_id", "beta_hat"), ["species", "comp_id"])
    error = F.col("rt") - at(0)
    for i in range(len(names)):
        error = error - at(i + 1) * F.col(f"x{i}")
    wide = wide.withColumn("e", error)
    sums = wide.groupBy("species", "comp_id").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("beta_hat").alias("beta_hat"), F.sum("e").alias("g"), *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(names))]
    )
    gradients = [F.abs(F.col("g")), *[F.abs(F.col(f"g{i}") - F.lit(p) * at(i + 1)) for i, p in enumerate(penalties)]]
    return sums.select("species", "comp_id", "n", F.size("beta_hat").alias("n_coef"), F.round(F.greatest(*gradients) / F.col("n"), 4).alias("residual"))


@query(
    "M9_shared_variance",
    with_views(
        FIT.format(keys="species, comp_id") + """, t AS (SELECT sum(sse) AS sse, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS dof FROM m)
        SELECT dof, round(2*sse / (dof + sqrt(dof*dof + 4*sse/25e-4)), 8) AS sigma2 FROM t""",
        "obs",
    ),
)
def _(spark, sf):
    stats = _stats(spark, sf, ["species", "comp_id"])
    v = R.shared_variance(R.residual_sums(stats, ["species", "comp_id"], 1, LAMBDA))
    return v.select("dof", F.round("sigma2", 8).alias("sigma2"))


@query(
    "M9_shared_noise_ridge",
    with_views(
        FIT.format(keys="species, comp_id") + """, t AS (SELECT 2*sum(sse) / (sum(greatest(n - 1, 0)) + sqrt(sum(greatest(n - 1, 0))*sum(greatest(n - 1, 0)) + 4*sum(sse)/25e-4)) AS s2 FROM m)
        SELECT species, comp_id, round(b, 6) AS b, round(w, 6) AS w, round(t.s2*v, 9) AS var_w FROM m, t""",
        "obs",
    ),
)
def _(spark, sf):
    coef, _ = R.fit(_fold(spark, sf, "train"), ["IS1"], "shared_noise_ridge", group="species", penalty=LAMBDA)
    at = lambda c, i, d, a: F.round(F.get(c, F.lit(i)), d).alias(a)
    return coef.select("species", "comp_id", at("beta_hat", 0, 6, "b"), at("beta_hat", 1, 6, "w"), at("beta_cov", 3, 9, "var_w"))


SCORE = FIT.format(keys="species, comp_id") + """, te AS (SELECT * FROM obs WHERE fold = 'test'),
  sc AS (SELECT te.*, m.n AS n_obs_train, m.b + m.w*IS1 AS pred_mean, sqrt(greatest(s2, 1e-12) + s2*(1e0/n + xm*xm*v) - 2*s2*v*xm*IS1 + s2*v*IS1*IS1) AS pred_std
    FROM te JOIN m ON te.species = m.species AND te.comp_id = m.comp_id),
  flagged AS (SELECT *, pred_mean - rt AS err, abs(pred_mean - rt) <= 1.959963984540054e0*pred_std AS covered, 2*1.959963984540054e0*pred_std AS width FROM sc)"""


def _scored(spark, sf):
    def build():
        return R.group_posterior(_stats(spark, sf, ["species", "comp_id"]), ["species", "comp_id"], 1, LAMBDA)

    coef = kept(spark, sf, "coef_is1", build)
    return SC.score(_fold(spark, sf, "test"), coef, ["IS1"], "species"), coef


@query(
    "M12_evaluation_overall",
    with_views(
        SCORE + f" SELECT (SELECT count(*) FROM te) AS n_test, count(*) AS n_used, (SELECT count(*) FROM te) - count(*) AS n_skipped, {RATIOS} FROM flagged", "obs"
    ),
)
def _(spark, sf):
    return rounded(M.overall(_scored(spark, sf)[0]))


@query(
    "M12_evaluation_by_group",
    with_views(SCORE + f" SELECT species, comp_id, n_obs_train, count(*) AS n_obs_test, {RATIOS} FROM flagged GROUP BY 1, 2, 3", "obs"),
)
def _(spark, sf):
    return rounded(M.by_group(_scored(spark, sf)[0], "species"))


BY_SUPPORT = f""", g AS (SELECT species, comp_id, sqrt(sum(err*err)/count(*)) AS rmse FROM flagged GROUP BY 1, 2),
        bins AS (SELECT species, comp_id, {BIN_SQL.format(n='n')} AS support_bin FROM m),
        gb AS (SELECT support_bin, count(*) AS n_groups, count(g.rmse) AS n_groups_with_test, round(avg(g.rmse), 6) AS rmse_mean, round(stddev_pop(g.rmse), 6) AS rmse_std,
          round(quantile_cont(g.rmse, 0.5), 6) AS rmse_p50, round(quantile_cont(g.rmse, 0.9), 6) AS rmse_p90, round(quantile_cont(g.rmse, 0.99), 6) AS rmse_p99
          FROM bins LEFT JOIN g ON bins.species = g.species AND bins.comp_id = g.comp_id GROUP BY 1),
        rows_ AS (SELECT {BIN_SQL.format(n='n_obs_train')} AS support_bin, count(*) AS n_obs_test, {RATIOS} FROM flagged GROUP BY 1)
        SELECT gb.support_bin, n_groups, n_groups_with_test, coalesce(n_obs_test, 0) AS n_obs_test, rmse, mae, coverage_95, pred_std_mean, interval_width_mean,
          rmse_mean, rmse_std, rmse_p50, rmse_p90, rmse_p99 FROM gb LEFT JOIN rows_ ON gb.support_bin = rows_.support_bin"""


def _three_sql():
    """Held-out rows scored by ridge on three covariates: centred products, inverse by cofactors."""
    names = FEATURES
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    sums = [f"covar_pop({names[i]}, {names[j]})*count(*) + {LAMBDA if i == j else 0:e} AS {a(i, j)}" for i, j in pairs]
    sums += [f"covar_pop({f}, rt)*count(*) AS c{i}" for i, f in enumerate(names)] + [f"avg({f}) AS m{i}" for i, f in enumerate(names)]

    def cofactor(i, j):
        r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return f"({'-' if (i + j) % 2 else ''}({a(r[0], c[0])}*{a(r[1], c[1])} - {a(r[0], c[1])}*{a(r[1], c[0])}))"

    v = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    return f""", tr AS (SELECT * FROM obs WHERE fold = 'train'),
      s AS (SELECT species, comp_id, count(*) AS n, avg(rt) AS ym, var_pop(rt)*count(*) AS syy, {", ".join(sums)} FROM tr GROUP BY 1, 2),
      d AS (SELECT *, {" + ".join(f"{a(0, j)}*{cofactor(0, j)}" for j in range(3))} AS det FROM s),
      i3 AS (SELECT *, {", ".join(f"{cofactor(i, j)}/det AS {v(i, j)}" for i, j in pairs)} FROM d),
      w3 AS (SELECT *, {", ".join(f"{' + '.join(f'{v(i, j)}*c{j}' for j in range(3))} AS w{i}" for i in range(3))} FROM i3),
      m AS (SELECT *, (1e-6 + 5e-1*greatest(syy - w0*c0 - w1*c1 - w2*c2, 0)) / (1e0 + n/2e0) AS s2 FROM w3),
      te AS (SELECT * FROM obs WHERE fold = 'test'),
      x3 AS (SELECT te.*, m.*, {", ".join(f"te.{f} - m{i} AS x{i}" for i, f in enumerate(names))} FROM te JOIN m ON te.species = m.species AND te.comp_id = m.comp_id),
      sc AS (SELECT species, comp_id, rt, n AS n_obs_train, ym + w0*x0 + w1*x1 + w2*x2 AS pred_mean,
        sqrt(greatest(s2, 1e-12) + s2*(1e0/n + {" + ".join(f"x{i}*x{j}*{v(i, j)}" for i in range(3) for j in range(3))})) AS pred_std FROM x3),
      flagged AS (SELECT *, pred_mean - rt AS err, abs(pred_mean - rt) <= 1.959963984540054e0*pred_std AS covered, 2*1.959963984540054e0*pred_std AS width FROM sc)"""


@query("M12_flagship_evaluation", with_views(_three_sql() + BY_SUPPORT, "obs"))
def _(spark, sf):
    return flagship(spark, sf).drop("bin_idx")


@query(
    "M12_evaluation_by_support",
    with_views(
        SCORE + BY_SUPPORT,
        "obs",
    ),
)
def _(spark, sf):
    scored, coef = _scored(spark, sf)
    return rounded(M.by_support(scored, coef, "species").drop("bin_idx"))


@query(
    "J7_coefficient_lookup",
    with_views(
        SCORE + " SELECT te.species, count(*) AS n_rows, count(m.n) AS n_seen FROM te LEFT JOIN m ON te.species = m.species AND te.comp_id = m.comp_id GROUP BY 1", "obs"
    ),
)
def _(spark, sf):
    return _scored(spark, sf)[0].groupBy("species").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("seen").alias("n_seen"))


@query(
    "J16_support_map_join",
    with_views(
        SCORE + f""", mp AS (SELECT species, comp_id, CASE WHEN n <= 20 THEN 4 WHEN n <= 50 THEN 5 WHEN n <= 100 THEN 6 ELSE 7 END AS bin_idx FROM m WHERE n > 10 AND n <= 50)
        SELECT mp.bin_idx, count(DISTINCT (mp.species, mp.comp_id)) AS n_groups_with_test, count(*) AS n_obs_test, {RATIOS}
        FROM flagged f JOIN mp ON f.species = mp.species AND f.comp_id = mp.comp_id GROUP BY 1
        UNION ALL SELECT -1, NULL, count(*), NULL, NULL, NULL, NULL, NULL FROM flagged f LEFT JOIN mp ON f.species = mp.species AND f.comp_id = mp.comp_id WHERE mp.comp_id IS NULL""",
        "obs",
    ),
)
def _(spark, sf):
    scored, coef = _scored(spark, sf)
    n = F.col("n")
    mapping = coef.where((n > 10) & (n <= 50)).select(
        F.col("species").alias("species_cluster"), "comp_id", V.support_bin("n").alias("support_bin"), V.support_bin_index("n").alias("bin_idx")
    )
    out, missing = M.by_common_support(scored, mapping, "species")
    # rows that the map does not cover are reported under -1
    out = out.unionByName(missing.select(F.lit(-1).alias("bin_idx"), F.col("n_missing").alias("n_obs_test")), allowMissingColumns=True)
    return rounded(out.select("bin_idx", "n_groups_with_test", "n_obs_test", "rmse", "mae", "coverage_95", "pred_std_mean", "interval_width_mean"))


@query(
    "F13_F15_prediction_interval",
    with_views(
        SCORE + " SELECT l_orderkey, l_linenumber, l_partkey, sampleset_id, round(pred_mean, 6) AS pred_mean, round(pred_std, 6) AS pred_std, covered, round(width, 6) AS width FROM flagged", "obs"
    ),
)
def _(spark, sf):
    scored = _scored(spark, sf)[0].where("seen")
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "sampleset_id", "pred_mean", "pred_std", "covered", "width"))


@query(
    "F12_centre_and_rotate",
    with_views(
        "SELECT species, round(sum((IS1 - 25e0)*6e-1 + (RS1 - 5e-2)*8e-1), 4) AS u, round(sum((RS1 - 5e-2)*6e-1 - (IS1 - 25e0)*8e-1), 4) AS v FROM obs GROUP BY 1", "obs"
    ),
)
def _(spark, sf):
    x = V.transform_vector(F.array("IS1", "RS1"), [25.0, 0.05], [[0.6, -0.8], [0.8, 0.6]])
    t = view(spark, sf, "obs").select("species", x.alias("x"))
    return rounded(t.groupBy("species").agg(F.sum(F.get("x", F.lit(0))).alias("u"), F.sum(F.get("x", F.lit(1))).alias("v")), 4)


@query(
    "F14_diagonal_variance",
    with_views(
        SCORE + """ SELECT species, count(*) AS n_rows, round(avg(sqrt(greatest(s2, 1e-12) + s2*(1e0/n + xm*xm*v) + s2*v*IS1*IS1)), 6) AS mean_std
        FROM te JOIN m ON te.species = m.species AND te.comp_id = m.comp_id GROUP BY species""".replace("SELECT species,", "SELECT te.species,").replace("GROUP BY species", "GROUP BY te.species"),
        "obs",
    ),
)
def _(spark, sf):
    coef = _scored(spark, sf)[1]
    scored = SC.score(_fold(spark, sf, "test"), coef, ["IS1"], "species", full_covariance=False).where("seen")
    return rounded(scored.groupBy("species").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("pred_std").alias("mean_std")))


BUNDLE_SCORE = BUNDLE_SQL + """, rw AS (SELECT o.*, TRY_CAST(regexp_extract(species_group_raw, '^\\s*(\\d+)', 1) AS BIGINT) AS sc FROM obs o JOIN species_map s ON o.sampleset_id = s.sample_set_id),
  j AS (SELECT rw.*, g.b, g.b + g.is1*rw.IS1 + coalesce(g.rs1, 0)*rw.RS1 - rt AS err, 4e0*greatest(g.win, 1e-3) AS half
    FROM rw LEFT JOIN bundle g ON rw.sc = g.supercategory AND rw.comp_id = g.comp_id)"""


def _bundle_scored(spark, sf):
    rows = view(spark, sf, "obs").withColumnRenamed("sampleset_id", "sample_set_id")
    numbers = P.species_attributes(view(spark, sf, "species_map"), 2).select("sample_set_id", "supercategory")
    rows = P.lookup_join(rows, numbers, ["sample_set_id"], "left")
    models = stored(scans.bundle_models(scans.scan_bundle(spark, _bundle(spark, sf), 7)))
    return SC.score_bundle(rows, models, ["IS1", "RS1"])


@query(
    "J10_bundle_join_counts",
    with_views(
        BUNDLE_SCORE + " SELECT species_cluster, count(*) AS n_rows, count(*) FILTER (WHERE sc IS NULL) AS n_no_super, count(*) FILTER (WHERE sc IS NOT NULL AND b IS NULL) AS n_no_model FROM j GROUP BY 1",
        "obs", "species_map",
    ),
)
def _(spark, sf):
    return _bundle_scored(spark, sf).groupBy("species_cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("no_supercategory").alias("n_no_super"), F.count_if("no_model").alias("n_no_model"))


@query(
    "M13_bundle_evaluation",
    with_views(
        BUNDLE_SCORE + """ SELECT species_cluster, count(*) AS n_obs_test, round(sqrt(avg(err*err)), 5) AS rmse, round(avg(abs(err)), 5) AS mae,
        round(count(*) FILTER (WHERE abs(err) <= half)/count(*), 4) AS coverage_95, round(avg(2*half), 5) AS interval_width_mean FROM j WHERE b IS NOT NULL GROUP BY 1""",
        "obs", "species_map",
    ),
)
def _(spark, sf):
    out = M.finish(M.error_sums(_bundle_scored(spark, sf), ["species_cluster"]))
    r = lambda c, d: F.round(c, d).alias(c)
    return out.select("species_cluster", "n_obs_test", r("rmse", 5), r("mae", 5), r("coverage_95", 4), r("interval_width_mean", 5))


@query(
    "F16_fixed_window",
    "SELECT p_partkey, round(4e0*greatest(p_retailprice/1e6, 1e-3), 8) AS half_width FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(V.fixed_half_width(F.col("p_retailprice") / 1e6), 8).alias("half_width"))


# -- model storage -------------------------------------------------------------------------------


@query(
    "K4_model_round_trip",
    with_views(
        FIT.format(keys="species, comp_id") + " SELECT species, comp_id, n, round(b, 6) AS b, CAST(-1 AS BIGINT) AS supercat_id, 'IS1' AS features FROM m", "obs"
    ),
)
def _(spark, sf):
    coef = _scored(spark, sf)[1]
    path = _stored(spark, sf, "model", lambda p: sinks.save_model(coef, p, {"features": "IS1", "group": "species"}))
    model, config = sinks.load_model(spark, path)
    features = config.first()["features"]
    return rounded(model.select("species", "comp_id", "n", first("beta_hat").alias("b"), "supercat_id", F.lit(features).alias("features")))


def _metrics(spark, sf):
    """(folder of the written metrics, the three tables that were written)."""
    scored, coef = _scored(spark, sf)
    tables = M.overall(scored), M.by_group(scored, "species"), M.by_support(scored, coef, "species")
    return _stored(spark, sf, "metrics", lambda path: sinks.write_metrics(path, *tables)), tables


def _ddl(df):
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


@query(
    "K5_metrics_sink",
    with_views(SCORE + f" SELECT species, comp_id, n_obs_train, count(*) AS n_obs_test, {RATIOS} FROM flagged GROUP BY 1, 2, 3", "obs"),
)
def _(spark, sf):
    path, (_, by_group, _) = _metrics(spark, sf)
    return rounded(scans.scan_csv(spark, f"{path}/by_group", _ddl(by_group)))


@query("K5_metrics_sink_overall", ORACLES["M12_evaluation_overall"])
def _(spark, sf):
    path, (overall, _, _) = _metrics(spark, sf)
    return rounded(spark.read.schema(overall.schema).json(f"{path}/overall"))


@query("K5_metrics_sink_by_support", ORACLES["M12_evaluation_by_support"])
def _(spark, sf):
    path, (_, _, by_support) = _metrics(spark, sf)
    return rounded(scans.scan_csv(spark, f"{path}/by_support", _ddl(by_support)).drop("bin_idx"))


@query(
    "K8_training_run_sink",
    with_views(FIT.format(keys="species, comp_id") + " SELECT 'IS1' AS features, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM m", "obs"),
)
def _(spark, sf):
    def write(path):
        coef = _scored(spark, sf)[1]
        summary = coef.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))
        sinks.save_training(coef, path, {"features": "IS1"}, summary)

    path = _stored(spark, sf, "training", write)
    _, config = sinks.load_model(spark, path)
    summary = spark.read.json(f"{path}/summary")
    return summary.select(F.lit(config.first()["features"]).alias("features"), "n_groups", "n_rows")
