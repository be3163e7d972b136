"""Catalogue queries: counts, sufficient statistics, error metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.inputs import kept, table, view, with_views
from peakloom.catalog.registry import query, rounded
from peakloom.functions import values as V
from peakloom.operators import metrics as M
from peakloom.operators import preparation as P
from peakloom.operators import sums as S
from peakloom.operators import summaries as C
from peakloom.plans.ordered import exact_percentiles
from peakloom.plans.topk import top_k_per_group
from peakloom.sources import scans

PAIRS = ", pairs AS (SELECT species, comp_id, count(*) AS n_rows FROM obs GROUP BY 1, 2)"


def _pairs(spark, sf):
    return C.pair_counts(view(spark, sf, "obs"), ["species", "comp_id"])


@query("A1_pair_counts", with_views(PAIRS + " SELECT * FROM pairs", "obs"))
def _(spark, sf):
    return _pairs(spark, sf)


@query(
    "A2_species_rollup",
    with_views(
        PAIRS + " SELECT species, count(*) AS n_compounds, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM pairs GROUP BY 1", "obs"
    ),
)
def _(spark, sf):
    return C.species_rollup(_pairs(spark, sf), "species")


@query(
    "A3_cap_totals",
    with_views(
        PAIRS + """, caps AS (SELECT CAST(unnest([10, 20, 50, 100]) AS BIGINT) AS cap)
        SELECT cap, CAST(sum(least(n_rows, cap)) AS BIGINT) AS n_rows FROM pairs, caps GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    return C.cap_totals(_pairs(spark, sf))


@query(
    "A4_cap_summary",
    with_views(
        """, capped AS (SELECT 1 AS lib, k.cap, species_cluster, species, comp_id FROM (SELECT *, row_number() OVER
            (PARTITION BY species, comp_id ORDER BY l_orderkey, l_linenumber, l_partkey, sampleset_id, l_extendedprice) AS rn FROM obs) o
            JOIN (SELECT 5 AS cap UNION ALL SELECT 20) k ON rn <= k.cap)
        SELECT CAST(lib AS BIGINT) AS lib, CAST(cap AS BIGINT) AS cap, CAST(NULL AS BIGINT) AS species_cluster, count(*) AS n_rows,
          count(DISTINCT (species, comp_id)) AS n_pairs, round(count(*) * 100e0 / (SELECT count(*) FROM obs), 2) AS rows_pct_of_full
        FROM capped GROUP BY lib, cap
        UNION ALL SELECT lib, cap, species_cluster, count(*), count(DISTINCT (species, comp_id)), NULL FROM capped GROUP BY lib, cap, species_cluster""",
        "obs",
    ),
)
def _(spark, sf):
    obs = view(spark, sf, "obs")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "sampleset_id", "l_extendedprice"]
    ranked = top_k_per_group(obs, ["species", "comp_id"], [F.col(c) for c in order], 20, order, rank="rn")
    capped = ranked.select(
        F.lit(1).cast("long").alias("lib"), "species_cluster", "species", "comp_id",
        F.explode(F.filter(F.array(F.lit(5).cast("long"), F.lit(20).cast("long")), lambda c: c >= F.col("rn"))).alias("cap"),
    )
    full = obs.agg(F.lit(1).cast("long").alias("lib"), F.count(F.lit(1)).alias("n_full"))
    return C.cap_summary(capped, full)


@query("A5_distinct_ids", "SELECT DISTINCT l_suppkey AS sample_set_id FROM lineitem")
def _(spark, sf):
    return C.distinct_ids(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_set_id")), "sample_set_id")


BIN_SQL = """CASE WHEN {n} <= 1 THEN '<= 1' WHEN {n} <= 2 THEN '2-2' WHEN {n} <= 5 THEN '3-5' WHEN {n} <= 10 THEN '6-10'
 WHEN {n} <= 20 THEN '11-20' WHEN {n} <= 50 THEN '21-50' WHEN {n} <= 100 THEN '51-100' ELSE '> 100' END"""


@query(
    "A8_support_histogram",
    with_views(
        PAIRS + f" SELECT species, comp_id, n_rows, {BIN_SQL.format(n='n_rows')} AS support_bin FROM pairs", "obs"
    ),
)
def _(spark, sf):
    return C.support_histogram(view(spark, sf, "obs"), "species").drop("bin_idx")


@query("F7_right_closed_bins", f"SELECT p_partkey, {BIN_SQL.format(n='(p_partkey % 130)')} AS support_bin FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.support_bin(F.col("p_partkey") % 130).alias("support_bin"))


@query("A32_row_count", "SELECT count(*) AS n_rows FROM lineitem")
def _(spark, sf):
    return scans.row_count(spark, f"{sf}/lineitem.parquet")


# -- sufficient statistics -----------------------------------------------------------------------


# some targets are missing
GAPS = ", gaps AS (SELECT species, comp_id, IS1, RS1, CASE WHEN l_orderkey % 7 <> 0 THEN rt END AS rt FROM obs)"


def _gaps(spark, sf):
    return view(spark, sf, "obs").withColumn("rt", F.when(F.col("l_orderkey") % 7 != 0, F.col("rt")))


@query(
    "A9_raw_sums",
    with_views(
        GAPS + """, g AS (SELECT *, CASE WHEN rt IS NOT NULL THEN IS1 END AS x1, CASE WHEN rt IS NOT NULL THEN RS1 END AS x2 FROM gaps)
        SELECT species, comp_id, count(rt) AS n, count(*) - count(rt) AS n_left_out, round(coalesce(sum(x1), 0), 4) AS sx1, round(coalesce(sum(x2), 0), 4) AS sx2,
          round(coalesce(sum(rt), 0), 4) AS sy, round(coalesce(sum(rt*rt), 0), 4) AS syy, round(coalesce(sum(x1*x1), 0), 4) AS q11, round(coalesce(sum(x1*x2), 0), 4) AS q12,
          round(coalesce(sum(x2*x2), 0), 4) AS q22, round(coalesce(sum(x1*rt), 0), 4) AS t1, round(coalesce(sum(x2*rt), 0), 4) AS t2 FROM g GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    s = S.group_sums(_gaps(spark, sf), ["species", "comp_id"], ["IS1", "RS1"], missing="skip")
    at = lambda c, i: F.get(c, F.lit(i))
    return rounded(
        s.select(
            "species", "comp_id", "n", "n_left_out", at("sum_x", 0).alias("sx1"), at("sum_x", 1).alias("sx2"), F.col("sum_y").alias("sy"),
            F.col("sum_yy").alias("syy"), at("sum_xx", 0).alias("q11"), at("sum_xx", 2).alias("q12"), at("sum_xx", 3).alias("q22"),
            at("sum_xy", 0).alias("t1"), at("sum_xy", 1).alias("t2"),
        ),
        4,
    )


@query(
    "A10_two_grain_sums",
    with_views(
        """SELECT species_cluster, comp_id, count(*) AS n, round(sum(IS1), 3) AS sx, round(sum(IS1*rt), 3) AS sxy FROM obs GROUP BY 1, 2
        UNION ALL SELECT NULL, comp_id, count(*), round(sum(IS1), 3), round(sum(IS1*rt), 3) FROM obs GROUP BY 2""",
        "obs",
    ),
)
def _(spark, sf):
    fine, coarse = S.two_grains(view(spark, sf, "obs"), ["species_cluster", "comp_id"], ["comp_id"], ["IS1"])
    both = fine.unionByName(coarse, allowMissingColumns=True)
    return rounded(
        both.select("species_cluster", "comp_id", "n", F.get("sum_x", F.lit(0)).alias("sx"), F.get("sum_xy", F.lit(0)).alias("sxy")), 3
    )


@query(
    "A11_centred_sums",
    with_views(
        GAPS + """ SELECT species, comp_id, count(*) AS n, round(avg(IS1), 6) AS x_mean, round(avg(rt), 6) AS y_mean,
        round(sum(IS1*IS1) - count(*)*avg(IS1)*avg(IS1), 4) AS sxx, round(sum(IS1*rt) - count(*)*avg(IS1)*avg(rt), 4) AS sxy,
        round(sum(rt*rt) - count(*)*avg(rt)*avg(rt), 4) AS syy FROM gaps WHERE rt IS NOT NULL GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    # global centres first, then per group
    middle, level = S.global_means(_gaps(spark, sf), ["IS1"])
    c = S.centred(S.group_sums(_gaps(spark, sf), ["species", "comp_id"], ["IS1"], "rt", middle, level, "skip"), None, middle, level)
    first = lambda name: F.get(name, F.lit(0))
    return c.select(
        "species", "comp_id", "n", F.round(first("x_mean"), 6).alias("x_mean"), F.round("y_mean", 6).alias("y_mean"),
        F.round(first("xtx"), 4).alias("sxx"), F.round(first("xty"), 4).alias("sxy"), F.round("yty", 4).alias("syy"),
    )


@query(
    "A12_global_moments",
    with_views(
        """SELECT count(*) AS n, round(avg(IS1), 6) AS m1, round(avg(RS1), 6) AS m2, round(var_samp(IS1), 6) AS c11,
        round(covar_samp(IS1, RS1), 6) AS c12, round(var_samp(RS1), 6) AS c22 FROM obs""",
        "obs",
    ),
)
def _(spark, sf):
    m = S.feature_moments(view(spark, sf, "obs"), ["IS1", "RS1"])
    at = lambda c, i: F.get(c, F.lit(i))
    return rounded(
        m.select("n", at("mean", 0).alias("m1"), at("mean", 1).alias("m2"), at("covariance", 0).alias("c11"),
                 at("covariance", 1).alias("c12"), at("covariance", 3).alias("c22"))
    )


RUN = ["sampleset_id", "worksheet_id", "task_id"]


@query(
    "A13_run_means",
    with_views(
        """SELECT sampleset_id, worksheet_id, task_id, min(species) AS species, round(avg(IS1), 6) AS IS1, round(avg(RS1), 6) AS RS1
        FROM obs GROUP BY 1, 2, 3 HAVING min(species) = max(species)""",
        "obs",
    ),
)
def _(spark, sf):
    runs = S.run_means(view(spark, sf, "obs"), RUN, ["IS1", "RS1"])
    return rounded(S.require_single_owner(runs))


@query(
    "A33_run_metadata",
    """SELECT CAST(s_suppkey AS BIGINT) AS run, CAST(s_nationkey AS BIGINT) AS species, s_acctbal AS run_covariate_0 FROM supplier""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").select("l_suppkey").join(s, ["l_suppkey"]).select(
        F.col("l_suppkey").alias("run"), F.col("s_nationkey").cast("long").alias("species"), F.col("s_acctbal").alias("run_covariate_0")
    )
    return S.run_metadata(rows, "run")


# -- errors and coverage -----------------------------------------------------------------------

# A simple scored table: the prediction is the library time of the compound, sigma grows with tax.
SCORED = """, scored AS (SELECT *, 3e0 + 2e-2*comp_id + 1e-1 AS pred_mean, 5e-2 + ES_1 AS pred_std,
    (3e0 + 2e-2*comp_id + 1e-1) - rt AS err FROM obs),
  flagged AS (SELECT *, abs(err) <= 1.959963984540054e0 * pred_std AS covered, 2*1.959963984540054e0*pred_std AS width FROM scored)"""
RATIOS = """round(sqrt(sum(err*err)/count(*)), 6) AS rmse, round(sum(abs(err))/count(*), 6) AS mae,
  round(count(*) FILTER (WHERE covered)/count(*), 6) AS coverage_95, round(sum(pred_std)/count(*), 6) AS pred_std_mean,
  round(sum(width)/count(*), 6) AS interval_width_mean"""


def _scored(spark, sf):
    from peakloom.operators.scoring import with_errors

    obs = view(spark, sf, "obs").withColumns(
        {
            "pred_mean": F.expr("3e0 + 2e-2*comp_id + 1e-1"), "pred_std": F.expr("5e-2 + ES_1"),
            "seen": F.lit(True), "n_obs_train": F.lit(0).cast("long"),
        }
    )
    return with_errors(obs, "rt")


@query(
    "A14_error_sums",
    with_views(SCORED + f" SELECT species, count(*) AS n_obs_test, {RATIOS} FROM flagged GROUP BY species", "obs"),
)
def _(spark, sf):
    return rounded(M.finish(M.error_sums(_scored(spark, sf), ["species"])))


@query(
    "A15_overall_metrics",
    with_views(
        SCORED + f" SELECT count(*) AS n_test, count(*) AS n_used, CAST(0 AS BIGINT) AS n_skipped, {RATIOS} FROM flagged", "obs"
    ),
)
def _(spark, sf):
    return rounded(M.overall(_scored(spark, sf)))


@query(
    "A15_group_metrics",
    with_views(
        SCORED + f" SELECT species, comp_id, CAST(0 AS BIGINT) AS n_obs_train, count(*) AS n_obs_test, {RATIOS} FROM flagged GROUP BY 1, 2", "obs"
    ),
)
def _(spark, sf):
    return rounded(M.by_group(_scored(spark, sf), "species"))


RMSE = ", g AS (SELECT species, comp_id, species_cluster, sqrt(sum(err*err)/count(*)) AS rmse, count(*) AS n FROM flagged GROUP BY 1, 2, 3)"


@query(
    "A16_group_rmse_distribution",
    with_views(
        SCORED + RMSE + """ SELECT species_cluster, count(*) AS n_rmse, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
        round(quantile_cont(rmse, 0.5), 6) AS rmse_p50, round(quantile_cont(rmse, 0.9), 6) AS rmse_p90, round(quantile_cont(rmse, 0.99), 6) AS rmse_p99
        FROM g GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    groups = M.finish(M.error_sums(_scored(spark, sf), ["species", "comp_id", "species_cluster"]))
    return rounded(M.group_rmse_stats(groups, ["species_cluster"]))


@query(
    "A16_overall_rmse_distribution",
    with_views(
        SCORED + RMSE + """ SELECT count(*) AS n_rmse, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
        round(quantile_cont(rmse, 0.5), 6) AS rmse_p50, round(quantile_cont(rmse, 0.9), 6) AS rmse_p90, round(quantile_cont(rmse, 0.99), 6) AS rmse_p99 FROM g""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(M.group_rmse_stats(M.finish(M.error_sums(_scored(spark, sf), ["species", "comp_id"]))))


@query(
    "A17_weighted_rollup",
    with_views(
        SCORED + """, lab AS (SELECT DISTINCT species_cluster, CASE WHEN species_group_raw LIKE '%blood%' THEN 'blood' WHEN species_group_raw LIKE '%urine%' THEN 'urine'
            WHEN species_group_raw LIKE '%cells%' OR species_group_raw LIKE '%plants%' THEN 'cells' ELSE 'other' END AS category FROM species_map)
        SELECT category, f.species_cluster, count(*) AS n_obs_test, round(sqrt(sum(err*err)/count(*)), 6) AS rmse, round(sum(abs(err))/count(*), 6) AS mae,
          round(count(*) FILTER (WHERE covered)/count(*), 6) AS coverage_95, round(sum(width)/count(*), 6) AS interval_width_mean
        FROM flagged f JOIN lab ON f.species_cluster = lab.species_cluster GROUP BY ROLLUP (category, f.species_cluster)""",
        "obs", "species_map",
    ),
)
def _(spark, sf):
    groups = M.finish(M.error_sums(_scored(spark, sf), ["species_cluster", "comp_id"]))
    return rounded(M.roll_up_groups(groups, view(spark, sf, "species_map")))


@query(
    "J15_cluster_labels_join",
    with_views(
        """, lab AS (SELECT species_cluster, max(species_group_raw) AS label FROM species_map WHERE species_cluster <> 4 GROUP BY 1)
        SELECT o.species, coalesce(lab.species_cluster, -1) AS species_cluster, lab.label, count(*) AS n_rows FROM obs o
        LEFT JOIN lab ON o.species_cluster = lab.species_cluster GROUP BY 1, 2, 3""",
        "obs", "species_map",
    ),
)
def _(spark, sf):
    lab = view(spark, sf, "species_map").where("species_cluster <> 4").groupBy("species_cluster").agg(
        F.max("species_group_raw").alias("label"))
    counts = view(spark, sf, "obs").groupBy("species", "species_cluster").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = P.lookup_join(counts, lab.withColumn("known", F.col("species_cluster")), ["species_cluster"], "left")
    return joined.select("species", F.coalesce("known", F.lit(-1).cast("long")).alias("species_cluster"), "label", "n_rows")


@query(
    "P18_scored_groups_only",
    with_views(
        SCORED + """ SELECT species, comp_id, n_obs_test, rmse, coverage FROM (SELECT species, comp_id, count(*) FILTER (WHERE fold = 'test') AS n_obs_test,
          round(sqrt(sum(err*err) FILTER (WHERE fold = 'test') / nullif(count(*) FILTER (WHERE fold = 'test'), 0)), 6) AS rmse,
          round(count(*) FILTER (WHERE covered AND fold = 'test') / nullif(count(*) FILTER (WHERE fold = 'test'), 0), 6) AS coverage
          FROM flagged GROUP BY 1, 2) t WHERE n_obs_test > 0""",
        "obs",
    ),
)
def _(spark, sf):
    scored = _scored(spark, sf).withColumn("seen", F.col("fold") == "test")
    groups = _scored(spark, sf).select("species", "comp_id").distinct()
    sums = M.error_sums(scored, ["species", "comp_id"])
    table_ = M.finish(groups.join(sums, ["species", "comp_id"], "left"))
    return rounded(P.scored_only(table_).select("species", "comp_id", "n_obs_test", "rmse", "coverage"))


@query(
    "A27_coverage_at_levels",
    with_views(
        SCORED + """, lv(nominal, q) AS (VALUES (5e-1, 0.6744897501960817e0), (8e-1, 1.2815515655446008e0), (9e-1, 1.6448536269514715e0), (95e-2, 1.959963984540054e0))
        SELECT nominal, round(count(*) FILTER (WHERE abs(err) <= q * pred_std)/count(*), 6) AS empirical FROM flagged, lv GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(M.coverage_at_levels(_scored(spark, sf)))


def _prevalence_sql(unit, partner):
    return with_views(
        SCORED + f""", pr AS (SELECT {unit}, {partner}, avg(abs(err)) AS e FROM flagged GROUP BY 1, 2),
        un AS (SELECT {unit}, avg(e) AS e, count(*) AS n FROM pr GROUP BY 1)
        SELECT CASE WHEN n <= 2 THEN '<=2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS prevalence_bin,
          round(avg(e), 6) AS mean_abs_err, count(*) AS n_units FROM un GROUP BY 1""",
        "obs",
    )


@query("A28_error_by_species_prevalence", _prevalence_sql("sampleset_id", "compound_class"))
def _(spark, sf):
    return rounded(M.error_by_prevalence(_scored(spark, sf), "sampleset_id", "compound_class"))


@query("A28_error_by_compound_prevalence", _prevalence_sql("compound", "species_cluster"))
def _(spark, sf):
    return rounded(M.error_by_prevalence(_scored(spark, sf), "compound", "species_cluster"))


def _effect_sql(f):
    t = lambda v: f"CASE WHEN label = {v} THEN {f} END"
    return (
        f"SELECT '{f}' AS feature, round(abs(avg({t(1)}) - avg({t(0)})) / sqrt((var_samp({t(1)}) + var_samp({t(0)}))/2), 6) AS effect FROM lab"
    )


@query(
    "A29_effect_sizes",
    with_views(
        ", lab AS (SELECT IS1, RS1, ES_1, CASE WHEN comp_id < 15 THEN 1 ELSE 0 END AS label FROM obs) "
        + " UNION ALL ".join(_effect_sql(f) for f in ("IS1", "RS1", "ES_1")),
        "obs",
    ),
)
def _(spark, sf):
    df = view(spark, sf, "obs").withColumn("label", (F.col("comp_id") < 15).cast("int"))
    return rounded(M.effect_sizes(df, ["IS1", "RS1", "ES_1"], "label"))


# probabilities with many ties: share of the value range, the label depends on the event type
PROBS = """, pr AS (SELECT event_id, event_type, floor(value) / 500e0 AS p, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS y FROM events)"""


def _probs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "event_type", (F.floor("value") / F.lit(500.0)).alias("p"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("y"),
    )


def _prob_sql(body):
    return "WITH " + PROBS[2:] + body


@query(
    "A30_curve_points",
    _prob_sql(
        """, st AS (SELECT p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM pr GROUP BY 1)
        SELECT p AS threshold, CAST(sum(a) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(b) OVER (ORDER BY p DESC) AS BIGINT) AS fp,
          round(sum(a) OVER (ORDER BY p DESC) / sum(a) OVER (), 6) AS tpr, round(sum(b) OVER (ORDER BY p DESC) / sum(b) OVER (), 6) AS fpr,
          round(sum(a) OVER (ORDER BY p DESC) / sum(a + b) OVER (ORDER BY p DESC), 6) AS precision FROM st"""
    ),
)
def _(spark, sf):
    points = M.curve_points(_probs(spark, sf))
    return rounded(points.select("threshold", "tp", "fp", "tpr", "fpr", "precision"))


@query(
    "A30_curve_areas",
    _prob_sql(
        """, st AS (SELECT p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM pr GROUP BY 1),
        cu AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS np, sum(b) OVER () AS nn FROM st WINDOW w AS (ORDER BY p DESC)),
        lg AS (SELECT tp / np AS tpr, fp / nn AS fpr, tp / (tp + fp) AS prec, lag(tp / np, 1, 0) OVER w AS tpr0, lag(fp / nn, 1, 0) OVER w AS fpr0,
          lag(tp / (tp + fp), 1, 1) OVER w AS prec0 FROM cu WINDOW w AS (ORDER BY p DESC))
        SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS roc_auc, round(sum((tpr - tpr0) * (prec + prec0) / 2), 6) AS pr_auc FROM lg"""
    ),
)
def _(spark, sf):
    return rounded(M.curve_areas(M.curve_points(_probs(spark, sf))))


@query(
    "A31_reliability_curve",
    _prob_sql(
        """ SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, count(*) AS n
        FROM pr GROUP BY 1"""
    ),
)
def _(spark, sf):
    return rounded(M.reliability_curve(_probs(spark, sf)))


ECE_SQL = """, q AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS c FROM pr),
  bn AS (SELECT event_type, CASE WHEN c * 10 <= 1 THEN 1 ELSE ceil(c * 10) END AS bin, c, y FROM q)"""


@query(
    "A22_calibration_error",
    _prob_sql(
        ECE_SQL + """, b AS (SELECT bin, count(*) AS n, avg(c) AS c, avg(y) AS y FROM bn GROUP BY 1)
        SELECT round(sum(n * abs(c - y)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n_pairs FROM b"""
    ),
)
def _(spark, sf):
    return rounded(M.expected_calibration_error(_probs(spark, sf)))


@query(
    "A22_macro_calibration_error",
    _prob_sql(
        ECE_SQL + """, b AS (SELECT event_type, bin, count(*) AS n, avg(c) AS c, avg(y) AS y FROM bn GROUP BY 1, 2),
        e AS (SELECT event_type, sum(n * abs(c - y)) / sum(n) AS ece FROM b GROUP BY 1) SELECT round(avg(ece), 6) AS ece_ovr FROM e"""
    ),
)
def _(spark, sf):
    return rounded(M.macro_calibration_error(_probs(spark, sf), "event_type"))


@query("A23_brier_score", _prob_sql(" SELECT round(avg((p - y) * (p - y)), 6) AS brier_ovr FROM pr"))
def _(spark, sf):
    return rounded(M.brier(_probs(spark, sf)))


@query(
    "U1_concatenate_frames",
    """SELECT 'customer' AS origin, c_nationkey AS nation, count(*) AS n_rows, CAST(NULL AS DOUBLE) AS balance FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier', s_nationkey, NULL, round(sum(s_acctbal), 2) FROM supplier GROUP BY 2""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_rows"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return P.unify([c.withColumn("origin", F.lit("customer")), s.withColumn("origin", F.lit("supplier"))])


@query(
    "F22_signal_to_noise",
    with_views(
        """, b AS (SELECT species, quantile_cont(intensity, 0.1) AS p10 FROM peaks GROUP BY 1)
        SELECT peak_id, round(intensity / (p10 + 1e-9), 6) AS snr FROM peaks JOIN b ON peaks.species = b.species""",
        "peaks",
    ),
)
def _(spark, sf):
    from peakloom.operators.context import signal_to_noise

    return rounded(signal_to_noise(view(spark, sf, "peaks")).select("peak_id", "snr"))


@query(
    "A16_percentiles_per_key",
    """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def _(spark, sf):
    return rounded(exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p99": 0.99}))
