"""Catalogue queries: candidates, context, probabilities and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.inputs import is_kept, kept, table, view, with_views
from peakloom.catalog.preparation import fraction_sql
from peakloom.catalog.registry import query, rounded
from peakloom.operators import context as X
from peakloom.plans.joins import grown_join

SHIFTS_SQL = "(VALUES (1.00335e0), (21.9819e0), (37.9559e0), (18.0338e0), (-18.0106e0), (-43.9898e0)) d(shift)"
PARTNER_SQL = f"""iso AS (SELECT a.peak_id, b.intensity AS i2, row_number() OVER (PARTITION BY a.peak_id ORDER BY abs(b.mass - (a.mass + 1.00335e0)), b.peak_id) AS rn
    FROM peaks a JOIN peaks b ON a.species = b.species AND abs(b.mass - (a.mass + 1.00335e0)) < 1e-2 AND abs(b.rt - a.rt) < 1e-1),
  add_ AS (SELECT a.peak_id, count(DISTINCT (sg, shift)) AS n FROM peaks a, {SHIFTS_SQL}, (VALUES (1), (-1)) s(sg)
    JOIN peaks b ON a.species = b.species AND abs(b.mass - (a.mass + sg*shift)) < 1e-2 AND abs(b.rt - a.rt) < 1e-1 GROUP BY 1),
  part_ AS (SELECT p.peak_id, CASE WHEN iso.i2 IS NULL THEN 0e0 ELSE 1e0 END AS has_isotope,
    CASE WHEN iso.i2 IS NULL THEN 0e0 WHEN iso.i2/p.intensity BETWEEN 11e-2 AND 33e-2 THEN 1e0 WHEN iso.i2/p.intensity BETWEEN 5e-2 AND 55e-2 THEN 7e-1 ELSE 3e-1 END AS isotope_score,
    coalesce(n, 0) * 1e0 AS n_adducts FROM peaks p LEFT JOIN iso ON p.peak_id = iso.peak_id AND iso.rn = 1 LEFT JOIN add_ ON p.peak_id = add_.peak_id)"""
CO_SQL = """co AS (SELECT a.peak_id, count(*) * 1e0 AS rt_cluster_size FROM peaks a JOIN peaks b ON a.species = b.species AND abs(b.rt - a.rt) < 1e-1 GROUP BY 1),
  cr AS (SELECT a.peak_id, greatest(count(*) - 1, 0) * 1e0 AS n_correlated FROM peaks a JOIN peaks b ON a.species = b.species AND abs(b.rt - a.rt) < 5e-1
    AND abs(ln(1 + b.intensity) - ln(1 + a.intensity)) < 1e0 GROUP BY 1)"""


def _peaks(spark, sf):
    return kept(spark, sf, "peaks", lambda: view(spark, sf, "peaks"))


@query("C1_partner_features", with_views(f", {PARTNER_SQL} SELECT * FROM part_", "peaks"))
def _(spark, sf):
    return X.partner_features(_peaks(spark, sf))


@query("F6_isotope_score", with_views(f", {PARTNER_SQL} SELECT isotope_score, count(*) AS n_peaks FROM part_ GROUP BY 1", "peaks"))
def _(spark, sf):
    return X.partner_features(_peaks(spark, sf)).groupBy("isotope_score").agg(F.count(F.lit(1)).alias("n_peaks"))


@query("W9_closest_partner", with_views(f", {PARTNER_SQL} SELECT peak_id, round(i2, 4) AS partner_intensity FROM iso WHERE rn = 1", "peaks"))
def _(spark, sf):
    p = _peaks(spark, sf)
    near = X.partners(p).where(F.col("probe") == X.ISOTOPE_PROBE).select("species", "mass", "rt", "partner_intensity")
    return rounded(grown_join(p.select("peak_id", "species", "mass", "rt"), near, ["species", "mass", "rt"]).select("peak_id", "partner_intensity"), 4)


@query("J13_isotope_adduct_join", with_views(f", {PARTNER_SQL} SELECT * FROM part_", "peaks"))
def _(spark, sf):
    # the same answer when every cell counts as crowded and is searched in order
    return X.partner_features(_peaks(spark, sf), cell_points=0)


@query(
    "J13_partner_pairs",
    with_views(
        f""" SELECT a.species, ion, direction, count(*) AS n_pairs, count(DISTINCT a.peak_id) AS n_peaks
        FROM peaks a, (VALUES ('M+13C', 1.00335e0), ('M+Na', 21.9819e0), ('M+K', 37.9559e0), ('M+NH4', 18.0338e0), ('M-H2O+H', -18.0106e0), ('M-CO2+H', -43.9898e0)) d(ion, shift),
          (VALUES (1), (-1)) s(direction)
        JOIN peaks b ON a.species = b.species AND abs(b.mass - (a.mass + direction*shift)) < 1e-2 AND abs(b.rt - a.rt) < 1e-1 GROUP BY 1, 2, 3""",
        "peaks",
    ),
)
def _(spark, sf):
    return X.pair_counts(_peaks(spark, sf))


@query("F23_coelution_counts", with_views(f", {CO_SQL} SELECT co.peak_id, rt_cluster_size, n_correlated FROM co JOIN cr ON co.peak_id = cr.peak_id", "peaks"))
def _(spark, sf):
    p = _peaks(spark, sf)
    return grown_join(X.coelution_counts(p), X.correlated_counts(p), ["peak_id"])


# -- candidates --------------------------------------------------------------------------------



from peakloom.functions import values as V  # noqa: E402
from peakloom.operators import assignment as A  # noqa: E402
from peakloom.operators import candidates as C  # noqa: E402
from peakloom.operators import presence as PR  # noqa: E402

IONS_SQL = """(VALUES (0, 'M+H', 0e0), (1, 'M+13C', 1.00335e0), (2, 'M+Na', 21.9819e0), (3, 'M+K', 37.9559e0), (4, 'M+NH4', 18.0338e0),
    (5, 'M-H2O+H', -18.0106e0), (6, 'M-CO2+H', -43.9898e0)) io(ion_idx, ion, shift)"""
MATCH_SQL = f"""li AS (SELECT compound_id, is_decoy, ion, ion_idx, mass + shift AS theo FROM library, {IONS_SQL} WHERE mass + shift >= 0),
  mm AS (SELECT p.*, li.compound_id, is_decoy, ion, theo, row_number() OVER (PARTITION BY peak_id, li.compound_id ORDER BY abs(p.mass - theo), ion_idx) AS rn
    FROM peaks p JOIN li ON p.mass BETWEEN theo - 2e-5*theo AND theo + 2e-5*theo AND abs(p.mass - theo) <= 10e0*greatest(theo, 1e-6)*1e-6),
  ma AS (SELECT * FROM mm WHERE rn = 1)"""
CAND_SQL = MATCH_SQL + """, ca AS (SELECT ma.*, rt_mean, rt_std, (rt - rt_mean)/greatest(rt_std, 5e-2) AS rt_z FROM ma JOIN rt_pred r
    ON ma.species = r.species AND ma.compound_id = r.compound_id WHERE abs((rt - rt_mean)/greatest(rt_std, 5e-2)) <= 15e-1)"""
CVIEWS = ("peaks", "library", "rt_pred")


def _library(spark, sf):
    return view(spark, sf, "library")


def _matches(spark, sf):
    return kept(spark, sf, "matches", lambda: C.mass_matches(_peaks(spark, sf), _library(spark, sf)))


def _in_window(spark, sf):
    return C.window_matches(_peaks(spark, sf), _library(spark, sf), view(spark, sf, "rt_pred"))


def _generate(spark, sf):
    peaks = _peaks(spark, sf)
    return C.generate(peaks, _library(spark, sf), view(spark, sf, "rt_pred"), X.context_features(peaks))


def _candidates(spark, sf):
    return kept(spark, sf, "candidates", lambda: _generate(spark, sf))


@query(
    "J11_mass_window_join",
    with_views(f", {MATCH_SQL} SELECT peak_id, compound_id, ion, round(theo, 6) AS theoretical FROM ma", "peaks", "library"),
)
def _(spark, sf):
    return rounded(C.mass_matches(_peaks(spark, sf), _library(spark, sf)).select("peak_id", "compound_id", "ion", "theoretical"))


@query(
    "J12_rt_window_filter",
    with_views(f", {CAND_SQL} SELECT peak_id, compound_id, round(rt_z, 6) AS rt_z FROM ca", *CVIEWS),
)
def _(spark, sf):
    return rounded(_in_window(spark, sf).select("peak_id", "compound_id", "rt_z"))


@query(
    "F2_F5_candidate_features",
    with_views(
        f""", {CAND_SQL} SELECT peak_id, compound_id, round((mass - theo)/theo*1e6, 5) AS mass_err_ppm, round(rt_z, 5) AS rt_z, round(ln(1 + intensity), 5) AS log_intensity,
        round(ln(rt_std + 1e-6), 5) AS log_rt_uncertainty, CASE WHEN ion = 'M+H' THEN 1e0 ELSE 0e0 END AS is_MH, CASE WHEN ion = 'M+Na' THEN 1e0 ELSE 0e0 END AS is_MNa FROM ca""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    cols = ["mass_err_ppm", "rt_z", "log_intensity", "log_rt_uncertainty", "is_MH", "is_MNa"]
    return rounded(_candidates(spark, sf).select("peak_id", "compound_id", *cols), 5)


@query(
    "C2_candidate_table",
    with_views(
        f""", {CAND_SQL}, {PARTNER_SQL}, {CO_SQL} SELECT ca.peak_id, ca.species, ca.compound_id, is_decoy, ion, round((mass - theo)/theo*1e6, 5) AS mass_err_ppm,
        round(rt_z, 5) AS rt_z, has_isotope, isotope_score, n_adducts, rt_cluster_size, n_correlated
        FROM ca JOIN part_ ON ca.peak_id = part_.peak_id JOIN co ON ca.peak_id = co.peak_id JOIN cr ON ca.peak_id = cr.peak_id""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    c = _candidates(spark, sf)
    return rounded(c.select("peak_id", "species", "compound_id", "is_decoy", "ion", "mass_err_ppm", "rt_z", *C.CONTEXT), 5)


ION_FLAGS = (("is_MH", "M+H"), ("is_M13C", "M+13C"), ("is_MNa", "M+Na"), ("is_MK", "M+K"), ("is_MNH4", "M+NH4"), ("is_MH2O_loss", "M-H2O+H"), ("is_MCO2_loss", "M-CO2+H"))
FLAG_SQL = ", ".join(f"CASE WHEN ion = '{ion}' THEN 1e0 ELSE 0e0 END AS {name}" for name, ion in ION_FLAGS)


@query("C2_ion_indicators", with_views(f", {CAND_SQL} SELECT peak_id, compound_id, {FLAG_SQL} FROM ca", *CVIEWS))
def _(spark, sf):
    return _candidates(spark, sf).select("peak_id", "compound_id", *[name for name, _ in ION_FLAGS])


@query(
    "C2_training_rows",
    with_views(
        f""", {CAND_SQL}, {PARTNER_SQL}, {CO_SQL} SELECT ca.peak_id, ca.species, ca.compound_id, round((mass - theo)/theo*1e6, 5) AS mass_err_ppm, round(rt_z, 5) AS rt_z,
        round(ln(1 + intensity), 5) AS log_intensity, round(ln(rt_std + 1e-6), 5) AS log_rt_uncertainty, has_isotope, isotope_score, n_adducts, rt_cluster_size, n_correlated, {FLAG_SQL}
        FROM ca JOIN part_ ON ca.peak_id = part_.peak_id JOIN co ON ca.peak_id = co.peak_id JOIN cr ON ca.peak_id = cr.peak_id WHERE NOT is_decoy""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    """All 16 features of the candidates that take part in training."""
    return rounded(C.training_rows(_candidates(spark, sf)), 5)


SLOT_SQL = CAND_SQL + """, nu AS (SELECT peak_id, species, true_compound, compound_id, is_decoy, mass, theo, rt_z, intensity, rt_std, ion,
      CAST(row_number() OVER (PARTITION BY peak_id ORDER BY compound_id) AS INTEGER) AS slot FROM ca),
  sl0 AS (SELECT peak_id, species, true_compound, compound_id, is_decoy, slot, (mass - theo)/theo*1e6 AS me, rt_z FROM nu
    UNION ALL SELECT peak_id, species, true_compound, NULL, NULL, 0, NULL, NULL FROM peaks),
  sl AS (SELECT *, CASE WHEN true_compound IS NULL THEN 0 ELSE coalesce(max(CASE WHEN compound_id = true_compound THEN slot END) OVER (PARTITION BY peak_id), -1) END AS label FROM sl0)"""


def _slots(spark, sf):
    # candidates that nothing else has needed yet are numbered where they are made, and written once
    made = lambda: _candidates(spark, sf) if is_kept(spark, sf, "candidates") else _generate(spark, sf)
    return kept(spark, sf, "slots", lambda: C.number_slots(made(), _peaks(spark, sf)))


@query("W4_candidate_slots", with_views(f", {SLOT_SQL} SELECT peak_id, compound_id, slot, label FROM sl", *CVIEWS))
def _(spark, sf):
    return _slots(spark, sf).select("peak_id", "compound_id", "slot", "label")


@query(
    "F21_feature_scaling",
    with_views(
        f""", {SLOT_SQL}, st AS (SELECT avg(me) AS m1, stddev_pop(me) AS s1, avg(rt_z) AS m2, stddev_pop(rt_z) AS s2 FROM sl WHERE slot > 0 AND NOT is_decoy)
        SELECT peak_id, compound_id, round((me - m1)/s1, 5) AS mass_err_ppm, round((rt_z - m2)/s2, 5) AS rt_z FROM sl, st WHERE slot > 0""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    c = _slots(spark, sf).where("slot > 0")
    z = C.standardise(c, C.feature_scaler(c.where(~F.col("is_decoy"))))
    return rounded(z.select("peak_id", "compound_id", "mass_err_ppm", "rt_z"), 5)


@query(
    "C3_seed_labels",
    with_views(
        f""", {SLOT_SQL}, us AS (SELECT peak_id, label FROM sl WHERE slot = 0 AND label >= 0),
        rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(peak_id AS VARCHAR), '42')), peak_id) AS rn FROM us)
        SELECT peak_id, label FROM rk WHERE rn <= greatest(1, (SELECT floor(count(*) * 5e-2) FROM us))""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return C.seed_labels(_slots(spark, sf), 0.05, 42)


@query(
    "J14_species_compound_predictions",
    with_views(
        """, tr AS (SELECT species, comp_id, count(*) AS n, avg(IS1) AS xm, avg(rt) AS ym, sum(IS1*IS1) - count(*)*avg(IS1)*avg(IS1) AS sxx,
            sum(IS1*rt) - count(*)*avg(IS1)*avg(rt) AS sxy, sum(rt*rt) - count(*)*avg(rt)*avg(rt) AS syy FROM obs WHERE fold = 'train' GROUP BY 1, 2),
        m AS (SELECT *, sxy/(sxx + 1e-3) AS w, (1e-6 + 5e-1*greatest(syy - sxy/(sxx + 1e-3)*sxy, 0))/(1e0 + n/2e0) AS s2, 1/(sxx + 1e-3) AS v FROM tr),
        ru AS (SELECT sampleset_id, worksheet_id, task_id, min(species) AS species, avg(IS1) AS x FROM obs GROUP BY 1, 2, 3),
        fr AS (SELECT species, x FROM (SELECT species, x, row_number() OVER (PARTITION BY species ORDER BY sampleset_id*1000000 + worksheet_id*100 + task_id) AS rn FROM ru) q WHERE rn = 1)
        SELECT m.species, comp_id AS compound_id, round(ym - w*xm + w*x, 6) AS rt_mean, round(sqrt(s2 + s2*(1e0/n + v*(xm - x)*(xm - x))), 6) AS rt_std FROM m JOIN fr ON m.species = fr.species""",
        "obs",
    ),
)
def _(spark, sf):
    from peakloom.catalog.models import _scored
    from peakloom.operators import sums as S

    coef = _scored(spark, sf)[1].withColumnRenamed("comp_id", "compound_id")
    runs = S.run_means(view(spark, sf, "obs"), ["sampleset_id", "worksheet_id", "task_id"], ["IS1"]).withColumn(
        "run", F.expr("sampleset_id*1000000 + worksheet_id*100 + task_id")
    )
    return rounded(C.rt_predictions(coef, runs, ["IS1"]))


COMPLEXITY_SQL = """, lb AS (SELECT compound_id, mass, 2e0 + 2e-1*(compound_id % 50) AS rt_mean, 1e-1 + 1e-2*(compound_id % 5) AS rt_std FROM library),
  hi AS (SELECT p.peak_id, count(*) AS n FROM peaks p JOIN lb ON p.mass BETWEEN lb.mass - 11e-3 AND lb.mass + 11e-3 AND abs(lb.mass - p.mass) < 1e-2
     AND abs(p.rt - rt_mean) < 2*rt_std GROUP BY 1),
  cn AS (SELECT p.peak_id, coalesce(n, 0) AS n_candidates FROM peaks p LEFT JOIN hi ON p.peak_id = hi.peak_id)"""


@query(
    "A26_candidate_complexity",
    with_views(
        COMPLEXITY_SQL + """ SELECT round(avg(n_candidates), 6) AS mean_candidates, min(n_candidates) AS min_candidates, max(n_candidates) AS max_candidates,
        count(*) FILTER (WHERE n_candidates = 0) AS peaks_with_0, count(*) FILTER (WHERE n_candidates = 1) AS peaks_with_1, count(*) FILTER (WHERE n_candidates >= 2) AS peaks_with_2plus,
        count(*) FILTER (WHERE n_candidates >= 5) AS peaks_with_5plus, count(*) FILTER (WHERE n_candidates >= 10) AS peaks_with_10plus,
        quantile_cont(n_candidates * 1e0, 0.5) AS median_candidates FROM cn""",
        "peaks", "library",
    ),
)
def _(spark, sf):
    lib = _library(spark, sf).withColumns({"rt_mean": F.expr("2e0 + 2e-1*(compound_id % 50)"), "rt_std": F.expr("1e-1 + 1e-2*(compound_id % 5)")})
    return rounded(C.complexity_stats(C.complexity(_peaks(spark, sf), lib, 0.01)))


# -- priors --------------------------------------------------------------------------------------


@query(
    "C4_presence_prior",
    with_views("SELECT species, true_compound AS compound_id, 1e0 + count(*) AS alpha, 1e0 AS beta FROM peaks WHERE true_compound IS NOT NULL GROUP BY 1, 2", "peaks"),
)
def _(spark, sf):
    seen = _peaks(spark, sf).where("true_compound IS NOT NULL").select("species", F.col("true_compound").alias("compound_id"))
    return PR.initial_prior(seen)


@query(
    "F17_beta_moments",
    with_views(
        """, pr AS (SELECT species, true_compound AS compound_id, 1e0 + count(*) AS a, 1e0 AS b FROM peaks WHERE true_compound IS NOT NULL GROUP BY 1, 2)
        SELECT species, compound_id, round(a/(a + b), 6) AS mean, round(a*b/((a + b)*(a + b)*(a + b + 1)), 6) AS variance, round(ln(a/(a + b)), 6) AS log_prior FROM pr""",
        "peaks",
    ),
)
def _(spark, sf):
    seen = _peaks(spark, sf).where("true_compound IS NOT NULL").select("species", F.col("true_compound").alias("compound_id"))
    p = PR.initial_prior(seen)
    return rounded(p.select("species", "compound_id", V.beta_mean("alpha", "beta").alias("mean"), V.beta_variance("alpha", "beta").alias("variance"), V.log_prior("alpha", "beta").alias("log_prior")))


LAB_SQL = """, lb AS (SELECT species, true_compound AS compound_id FROM peaks WHERE intensity > 1e6)"""


def _labelled(spark, sf):
    return _peaks(spark, sf).where("intensity > 1e6").select("peak_id", "species", F.col("true_compound").alias("compound_id"))


@query(
    "C5_batch_prior",
    with_views(LAB_SQL + " SELECT DISTINCT species, compound_id, 2e0 AS alpha, 1e0 AS beta FROM lb WHERE compound_id IS NOT NULL", "peaks"),
)
def _(spark, sf):
    return PR.batch_update(_labelled(spark, sf))[0]


@query(
    "C5_batch_null_prior",
    with_views(
        LAB_SQL + """, ct AS (SELECT species, count(*) FILTER (WHERE compound_id IS NULL) AS a, count(compound_id) AS b FROM lb GROUP BY 1)
        SELECT round(1 + sum(ln(1e0 + a)), 6) AS alpha_null, round(1 + sum(ln(1e0 + b)), 6) AS beta_null FROM ct""",
        "peaks",
    ),
)
def _(spark, sf):
    return rounded(PR.batch_update(_labelled(spark, sf))[1])


@query(
    "C6_interactive_prior",
    with_views(
        f""", {CAND_SQL}, lb AS (SELECT peak_id, species, true_compound AS ch FROM peaks WHERE intensity > 1e6),
        ev AS (SELECT species, ch AS compound_id, 1e0 AS da, 0e0 AS db FROM lb WHERE ch IS NOT NULL
          UNION ALL SELECT lb.species, ca.compound_id, 0e0, 25e-2 FROM ca JOIN lb ON ca.peak_id = lb.peak_id WHERE ch IS NOT NULL AND ca.compound_id <> ch)
        SELECT species, compound_id, 1 + sum(da) AS alpha, 1 + sum(db) AS beta FROM ev GROUP BY 1, 2""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    events = PR.label_events(_labelled(spark, sf), _candidates(spark, sf))
    start = PR.initial_prior(_labelled(spark, sf).where("1 = 0"))
    return PR.apply_events(start, events)


@query(
    "K6_prior_round_trip",
    with_views(LAB_SQL + " SELECT DISTINCT species, compound_id, 2e0 AS alpha, 1e0 AS beta FROM lb WHERE compound_id IS NOT NULL", "peaks"),
)
def _(spark, sf):
    from peakloom.catalog.storage import _stored
    from peakloom.sources import sinks

    path = _stored(spark, sf, "prior", lambda p: sinks.save_prior(PR.batch_update(_labelled(spark, sf))[0], p))
    return sinks.load_prior(spark, path)


# -- probabilities -------------------------------------------------------------------------------

THETA = {"mass_err_ppm": -0.02, "rt_z": -0.3}
SCORE_SQL = SLOT_SQL + """, lb AS (SELECT species, true_compound AS compound_id FROM peaks WHERE intensity > 1e6),
  pr AS (SELECT DISTINCT species, compound_id FROM lb WHERE compound_id IS NOT NULL),
  ct AS (SELECT species, count(*) FILTER (WHERE compound_id IS NULL) AS a, count(compound_id) AS b FROM lb GROUP BY 1),
  nl AS (SELECT (1 + sum(ln(1e0 + a))) / (2 + sum(ln(1e0 + a)) + sum(ln(1e0 + b))) AS pn FROM ct),
  lg AS (SELECT sl.*, CASE WHEN pr.compound_id IS NULL THEN 5e-1 ELSE 2e0/3e0 END AS pi FROM sl LEFT JOIN pr ON sl.species = pr.species AND sl.compound_id = pr.compound_id)"""
PROB_SQL = SCORE_SQL + """, ex AS (SELECT lg.*, CASE WHEN slot = 0 THEN exp(-5e-1)*pn ELSE exp(1e0 - 2e-2*me - 3e-1*rt_z)*pi END AS e FROM lg, nl),
  pb AS (SELECT peak_id, species, true_compound, slot, compound_id, is_decoy, e / sum(e) OVER (PARTITION BY peak_id) AS p FROM ex)"""


def _prior_slots(spark, sf):
    prior, null = PR.batch_update(_labelled(spark, sf))
    return A.with_log_prior(_slots(spark, sf), prior, PR.log_null(null))


def _probs(spark, sf):
    return kept(spark, sf, "probs", lambda: A.probabilities(_prior_slots(spark, sf), THETA, 1.0, -0.5).select("peak_id", "slot", "compound_id", "p"))


@query("C7_softmax_probabilities", with_views(f", {PROB_SQL} SELECT peak_id, slot, compound_id, round(p, 6) AS p FROM pb", *CVIEWS))
def _(spark, sf):
    return rounded(_probs(spark, sf).select("peak_id", "slot", "compound_id", "p"))


@query("F18_masked_softmax", with_views(f", {PROB_SQL} SELECT peak_id, count(*) AS n_slots, round(sum(p), 6) AS total, round(max(p), 6) AS top FROM pb GROUP BY 1", *CVIEWS))
def _(spark, sf):
    return rounded(_probs(spark, sf).groupBy("peak_id").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("p").alias("total"), F.max("p").alias("top")))


DRAWS = [
    {"theta0": 1.0, "theta_null": -0.5, "theta": {"mass_err_ppm": -0.02, "rt_z": -0.3}, "sigma_logit": 0.2},
    {"theta0": 0.8, "theta_null": -0.2, "theta": {"mass_err_ppm": -0.01, "rt_z": -0.5}, "sigma_logit": 0.2},
    {"theta0": 1.3, "theta_null": 0.1, "theta": {"mass_err_ppm": 0.03, "rt_z": 0.1}, "sigma_logit": 0.2},
]
DRAW_SQL = SCORE_SQL + """, dr(draw, t0, tn, w1, w2) AS (VALUES (0, 1e0, -5e-1, -2e-2, -3e-1), (1, 8e-1, -2e-1, -1e-2, -5e-1), (2, 13e-1, 1e-1, 3e-2, 1e-1)),
  ex AS (SELECT lg.peak_id, slot, compound_id, draw, CASE WHEN slot = 0 THEN exp(tn)*pn ELSE exp(t0 + w1*me + w2*rt_z)*pi END AS e FROM lg, nl, dr),
  ps AS (SELECT peak_id, slot, compound_id, draw, e / sum(e) OVER (PARTITION BY peak_id, draw) AS p FROM ex)"""


def _samples(spark, sf):
    return A.draw_probabilities(_prior_slots(spark, sf), DRAWS)


@query("C8_mean_over_draws", with_views(f", {DRAW_SQL} SELECT peak_id, slot, compound_id, round(avg(p), 6) AS p FROM ps GROUP BY 1, 2, 3", *CVIEWS))
def _(spark, sf):
    return rounded(A.mean_draw_probabilities(_prior_slots(spark, sf), DRAWS))


def _noise_sql(seed):
    return fraction_sql(["lg.peak_id", "slot", "draw"], seed)


NOISE_SQL = DRAW_SQL.replace("exp(tn)*pn", "exp(tn + z)*pn").replace("*rt_z)*pi", "*rt_z + z)*pi").replace(
    "FROM lg, nl, dr)", f"FROM (SELECT lg.*, dr.*, 2e-1*sqrt(-2e0*ln(greatest({_noise_sql(42)}, 1e-12)))*cos(2*pi()*{_noise_sql(43)}) AS z FROM lg, dr) lg, nl)"
)


@query("C8_noisy_draws", with_views(f", {NOISE_SQL} SELECT peak_id, slot, compound_id, round(avg(p), 5) AS p FROM ps GROUP BY 1, 2, 3", *CVIEWS))
def _(spark, sf):
    return rounded(A.mean_draw_probabilities(_prior_slots(spark, sf), DRAWS, noise_seed=42), 5)


@query(
    "C10_softmax_weights",
    with_views(
        f", {SLOT_SQL} SELECT count(*) AS n_peaks, CAST({len(C.FEATURES) + 2} AS BIGINT) AS n_parameters, true AS converged, 0e0 AS gradient FROM sl WHERE slot = 0 AND label >= 0",
        *CVIEWS,
    ),
)
def _(spark, sf):
    """Largest gradient of the posterior at the fitted weights, from the probabilities they give."""
    s = _prior_slots(spark, sf)
    z = C.standardise(s, C.feature_scaler(s.where("slot > 0 AND NOT is_decoy")))
    train = z.where("slot = 0 OR NOT is_decoy").where("label >= 0").withColumns({f: F.coalesce(f, F.lit(0.0)) for f in C.FEATURES})
    fit = A.fit_weights(train, C.FEATURES)
    p = A.probabilities(train, fit["theta"], fit["theta0"], fit["theta_null"])
    off = F.when(F.col("slot") == F.col("label"), 1.0).otherwise(0.0) - F.col("p")
    own = F.col("slot") > 0
    sums = [F.sum(F.when(~own, off)) - F.lit(fit["theta_null"]), F.sum(F.when(own, off)) - F.lit(fit["theta0"])]
    sums += [F.sum(F.when(own, off * F.col(f))) - F.lit(w) for f, w in fit["theta"].items()]
    return p.agg(
        F.count_if(~own).alias("n_peaks"), F.lit(len(sums)).cast("long").alias("n_parameters"), F.lit(fit["converged"]).alias("converged"),
        F.round(F.greatest(*[F.abs(v) for v in sums]), 3).alias("gradient"),
    )


# -- assignment ----------------------------------------------------------------------------------


@query(
    "W5_best_candidate",
    with_views(
        f""", {PROB_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY p DESC, slot) AS rn FROM pb)
        SELECT peak_id, slot, compound_id, round(p, 6) AS p FROM rk WHERE rn = 1""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(A.best_candidate(_probs(spark, sf)))


ASSIGN_SQL = PROB_SQL + """, asg AS (SELECT * FROM (SELECT peak_id, compound_id, p, is_decoy, row_number() OVER (PARTITION BY peak_id ORDER BY p DESC, slot) AS rank
    FROM pb WHERE slot > 0 AND p >= 3e-1) q WHERE rank <= 2),
  ev AS (SELECT peak_id, true_compound FROM peaks WHERE NOT intensity > 1e6),
  un AS (SELECT peak_id, compound_id FROM pb WHERE slot > 0 AND peak_id IN (SELECT peak_id FROM ev) UNION SELECT peak_id, true_compound FROM ev WHERE true_compound IS NOT NULL),
  pa AS (SELECT un.peak_id, un.compound_id, coalesce(pb.p, 0) AS p, CASE WHEN ev.true_compound = un.compound_id THEN 1 ELSE 0 END AS y, CASE WHEN asg.compound_id IS NULL THEN 0 ELSE 1 END AS yhat
    FROM un JOIN ev ON un.peak_id = ev.peak_id LEFT JOIN pb ON un.peak_id = pb.peak_id AND un.compound_id = pb.compound_id LEFT JOIN asg ON un.peak_id = asg.peak_id AND un.compound_id = asg.compound_id),
  tx AS (SELECT sum(y*yhat) AS tp, sum((1 - y)*yhat) AS fp, sum(y*(1 - yhat)) AS fn FROM pa),
  pk AS (SELECT ev.peak_id, coalesce(sum(yhat), 0) AS k, coalesce(sum(y), 0) AS t, coalesce(sum(y*yhat), 0) AS i FROM ev LEFT JOIN pa ON ev.peak_id = pa.peak_id GROUP BY 1)"""


def _truth(spark, sf):
    return _peaks(spark, sf).where(~(F.col("intensity") > 1e6)).select("peak_id", "true_compound")


def _assigned(spark, sf):
    return A.assign(_probs(spark, sf), 0.3, 2)


def _pairs(spark, sf):
    return kept(spark, sf, "pairs", lambda: A.evaluation_pairs(_probs(spark, sf), _assigned(spark, sf), _truth(spark, sf)))


@query("W6_threshold_top_k", with_views(f", {ASSIGN_SQL} SELECT peak_id, compound_id, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM asg", *CVIEWS))
def _(spark, sf):
    return rounded(_assigned(spark, sf))


@query("U4_pair_universe", with_views(f", {ASSIGN_SQL} SELECT peak_id, compound_id, round(p, 6) AS p, y, yhat FROM pa", *CVIEWS))
def _(spark, sf):
    return rounded(_pairs(spark, sf))


@query(
    "A18_pair_confusion",
    with_views(
        f""", {ASSIGN_SQL} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp/(tp + fp), 6) AS precision, round(tp/(tp + fn), 6) AS recall,
        round(2e0*tp/(2*tp + fp + fn), 6) AS f1 FROM tx""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(A.pair_metrics(_pairs(spark, sf)))


@query(
    "A19_peak_macro_metrics",
    with_views(
        f""", {ASSIGN_SQL} SELECT round(avg(CASE WHEN k + t = 0 THEN 1e0 ELSE 2e0*i/(k + t) END), 6) AS f1_macro, round(avg(CASE WHEN k + t = 0 THEN 1e0 ELSE i/(k + t - i) END), 6) AS jaccard_macro,
        round(avg(CASE WHEN t = 0 THEN CASE WHEN k > 0 THEN 1e0 ELSE 0e0 END END), 6) AS far_null, round(1 - avg(CASE WHEN t = 0 THEN CASE WHEN k > 0 THEN 1e0 ELSE 0e0 END END), 6) AS tnr_null,
        round(avg(CASE WHEN k > 0 THEN 1e0 ELSE 0e0 END), 6) AS assignment_rate, round(avg(abs(k - t)), 6) AS cardinality_mae FROM pk""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(A.peak_metrics(_pairs(spark, sf), _truth(spark, sf)))


COMPOUND_SQL = ASSIGN_SQL + """, prd AS (SELECT DISTINCT compound_id, is_decoy FROM asg WHERE peak_id IN (SELECT peak_id FROM ev)),
  tru AS (SELECT DISTINCT true_compound AS compound_id FROM ev WHERE true_compound IS NOT NULL),
  cx AS (SELECT (SELECT count(*) FROM prd WHERE NOT is_decoy AND compound_id IN (SELECT compound_id FROM tru)) AS identified, (SELECT count(*) FROM tru) AS total,
    (SELECT count(*) FROM prd WHERE is_decoy OR compound_id NOT IN (SELECT compound_id FROM tru)) AS false_positives,
    (SELECT count(*) FROM tru WHERE compound_id NOT IN (SELECT compound_id FROM prd)) AS missed, (SELECT count(*) FROM prd WHERE is_decoy) AS decoys_assigned, (SELECT count(*) FROM prd) AS predicted)"""


@query(
    "A20_compound_metrics",
    with_views(
        f""", {COMPOUND_SQL} SELECT *, round(identified/predicted, 6) AS compound_precision, round(identified/total, 6) AS compound_recall,
        round(2e0*(identified/predicted)*(identified/total)/((identified/predicted) + (identified/total)), 6) AS compound_f1 FROM cx""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(A.compound_metrics(_assigned(spark, sf), _truth(spark, sf), _library(spark, sf)))


@query(
    "U3_compound_set_algebra",
    with_views(
        f""", {COMPOUND_SQL} SELECT compound_id, CASE WHEN compound_id IN (SELECT compound_id FROM prd WHERE is_decoy) THEN 'decoy'
          WHEN compound_id NOT IN (SELECT compound_id FROM tru) THEN 'false' WHEN compound_id IN (SELECT compound_id FROM prd) THEN 'identified' ELSE 'missed' END AS outcome
        FROM (SELECT compound_id FROM prd UNION SELECT compound_id FROM tru) u""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    truth = _truth(spark, sf)
    pred = grown_join(_assigned(spark, sf), truth.select("peak_id"), ["peak_id"], "left_semi").select("compound_id").distinct()
    true = truth.where("true_compound IS NOT NULL").select(F.col("true_compound").alias("compound_id")).distinct()
    decoys = pred.intersect(_library(spark, sf).where("is_decoy").select("compound_id"))
    real = pred.exceptAll(decoys)
    named = lambda df, name: df.withColumn("outcome", F.lit(name))
    return (
        named(decoys, "decoy").unionByName(named(real.intersect(true), "identified"))
        .unionByName(named(real.exceptAll(real.intersect(true)), "false")).unionByName(named(grown_join(true, pred, ["compound_id"], "left_anti"), "missed"))
    )


@query("A21_compound_coverage", with_views(f", {ASSIGN_SQL} SELECT compound_id, round(avg(yhat), 6) AS coverage, count(*) AS n_peaks FROM pa WHERE y = 1 GROUP BY 1", *CVIEWS))
def _(spark, sf):
    return rounded(A.compound_coverage(_pairs(spark, sf)))


@query(
    "C9_assignment_evaluation",
    with_views(
        f""", {COMPOUND_SQL}, qq AS (SELECT compound_id, least(greatest(p, 1e-12), 1 - 1e-12) AS c, y FROM pa),
        bb AS (SELECT CASE WHEN c*10 <= 1 THEN 1 ELSE ceil(c*10) END AS bin, count(*) AS n, avg(c) AS c, avg(y) AS y FROM qq GROUP BY 1)
        SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp/(tp + fp), 6) AS precision, identified, false_positives, missed, decoys_assigned,
          (SELECT round(sum(n*abs(c - y))/sum(n), 6) FROM bb) AS ece, (SELECT round(avg((p - y)*(p - y)), 6) FROM pa) AS brier_ovr FROM tx, cx""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    peaks = _peaks(spark, sf).select("peak_id", "true_compound")
    m = A.evaluate(_probs(spark, sf), peaks, _library(spark, sf), 0.3, 2, labelled=_labelled(spark, sf))
    return rounded(m.select("tp", "fp", "fn", "precision", "identified", "false_positives", "missed", "decoys_assigned", "ece", "brier_ovr"))
