"""Catalogue queries: acquisition, batches, uncertainty, embeddings, curation, pooled and lasso models."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.catalog.assignment import (
    CVIEWS, DRAW_SQL, PROB_SQL, _candidates, _labelled, _peaks, _probs, _samples, _slots, _truth,
)
from peakloom.catalog.inputs import kept, table, view, with_views
from peakloom.catalog.models import FEATURES, FIT, _fold
from peakloom.catalog.preparation import _unseen_sql
from peakloom.catalog.registry import query, rounded
from peakloom.operators import candidates as C
from peakloom.operators import curation as U
from peakloom.operators import embeddings as E
from peakloom.operators import labelling as L
from peakloom.operators import lasso as LA
from peakloom.operators import metrics as M
from peakloom.operators import pooling as PO
from peakloom.operators import preparation as P
from peakloom.operators import presence as PR
from peakloom.operators import ridge as R
from peakloom.operators import scoring as SC
from peakloom.operators import sums as S
from peakloom.plans.durable import stored

TOP_SQL = PROB_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY p DESC, slot) AS rn FROM pb),
  pk AS (SELECT peak_id, max(CASE WHEN rn = 1 THEN p END) AS top, max(CASE WHEN rn = 1 THEN slot END) AS ts, max(CASE WHEN rn = 2 THEN p END) AS sec,
    -sum(greatest(p, 1e-12)*ln(greatest(p, 1e-12))) AS h FROM rk GROUP BY 1),
  ac AS (SELECT *, CASE WHEN ts > 0 AND top >= 6e-1 THEN 1 - top ELSE 0e0 END AS fp FROM pk)"""


def _acq(name, expr):
    def run(spark, sf):
        return rounded(L.acquisition(_probs(spark, sf), name, 0.6))

    query(f"L1_acquisition_{name}", with_views(f", {TOP_SQL} SELECT peak_id, round({expr}, 6) AS score FROM ac", *CVIEWS))(run)


_acq("fp", "fp")
_acq("entropy", "h")
_acq("lc", "1 - top")
_acq("margin", "coalesce(sec - top, 0e0)")
_acq("hybrid", "7e-1*fp + 3e-1*h")


@query("F19_W8_uncertainty_terms", with_views(f", {TOP_SQL} SELECT peak_id, round(top, 6) AS top, ts AS top_slot, round(sec, 6) AS second, round(h, 6) AS entropy FROM ac", *CVIEWS))
def _(spark, sf):
    return rounded(L.peak_summary(_probs(spark, sf)))


@query(
    "F20_mutual_information",
    with_views(
        f""", {DRAW_SQL}, mn AS (SELECT peak_id, slot, avg(p) AS p, avg(-p*ln(p)) AS h FROM ps GROUP BY 1, 2)
        SELECT peak_id, round(sum(-p*ln(p)) - sum(h), 5) AS score FROM mn GROUP BY 1""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(L.acquisition(_probs(spark, sf), "mi", samples=_samples(spark, sf)), 5)


@query(
    "W7_global_top_k",
    with_views(f", {TOP_SQL} SELECT peak_id, round(7e-1*fp + 3e-1*h, 6) AS score FROM ac ORDER BY round(7e-1*fp + 3e-1*h, 9) DESC, peak_id LIMIT 20", *CVIEWS),
)
def _(spark, sf):
    scores = L.acquisition(_probs(spark, sf), "hybrid", 0.6).withColumn("score", F.round("score", 9))
    return rounded(L.select_batch(scores, 20))


@query(
    "L2_U6_next_batch",
    with_views(
        f""", {TOP_SQL}, sc AS (SELECT peak_id, round(h, 9) AS score FROM ac), b1 AS (SELECT peak_id FROM sc ORDER BY score DESC, peak_id LIMIT 20)
        SELECT peak_id, round(score, 6) AS score FROM sc WHERE peak_id NOT IN (SELECT peak_id FROM b1) ORDER BY sc.score DESC, peak_id LIMIT 20""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    probs = _probs(spark, sf)
    scores = L.acquisition(probs, "entropy", 0.6).withColumn("score", F.round("score", 9))
    history = L.select_batch(scores, 20)
    rest = scores.join(history.select("peak_id"), ["peak_id"], "left_anti")
    return rounded(L.select_batch(rest, 20))


VECTORS = ["mass_err_ppm", "rt_z", "log_intensity"]


def _slot_probs(spark, sf):
    p = _probs(spark, sf).select("peak_id", "slot", "p")
    return _slots(spark, sf).select("peak_id", "slot", *VECTORS).join(p, ["peak_id", "slot"])


@query(
    "L3_expected_features",
    with_views(
        f""", {PROB_SQL}, jn AS (SELECT pb.*, sl.me, sl.rt_z FROM pb JOIN sl ON pb.peak_id = sl.peak_id AND pb.slot = sl.slot)
        SELECT peak_id, round(coalesce(sum(CASE WHEN slot > 0 THEN p*me END), 0)/(coalesce(sum(CASE WHEN slot > 0 THEN p END), 0) + 1e-12), 5) AS mass_err_ppm,
          round(coalesce(sum(CASE WHEN slot > 0 THEN p*rt_z END), 0)/(coalesce(sum(CASE WHEN slot > 0 THEN p END), 0) + 1e-12), 5) AS rt_z FROM jn GROUP BY 1""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    return rounded(L.expected_features(_slot_probs(spark, sf), ["mass_err_ppm", "rt_z"]), 5)


W10_PICK = """(SELECT c.peak_id FROM short c WHERE NOT list_contains(ids, c.peak_id)
    ORDER BY (SELECT min((c.v1 - d.v1)*(c.v1 - d.v1) + (c.v2 - d.v2)*(c.v2 - d.v2)) FROM short d WHERE list_contains(ids, d.peak_id)) DESC, c.score DESC, c.peak_id LIMIT 1)"""


@query(
    "W10_diverse_batch",
    with_views(
        f""", {TOP_SQL}, jn AS (SELECT pb.*, sl.me, sl.rt_z FROM pb JOIN sl ON pb.peak_id = sl.peak_id AND pb.slot = sl.slot),
        vc AS (SELECT peak_id, round(coalesce(sum(CASE WHEN slot > 0 THEN p*me END), 0)/(coalesce(sum(CASE WHEN slot > 0 THEN p END), 0) + 1e-12), 5) AS v1,
          round(coalesce(sum(CASE WHEN slot > 0 THEN p*rt_z END), 0)/(coalesce(sum(CASE WHEN slot > 0 THEN p END), 0) + 1e-12), 5) AS v2 FROM jn GROUP BY 1),
        short AS MATERIALIZED (SELECT ac.peak_id, round(7e-1*fp + 3e-1*h, 6) AS score, v1, v2 FROM ac JOIN vc ON ac.peak_id = vc.peak_id ORDER BY 2 DESC, 1 LIMIT 60),
        picks(pick, ids) AS (SELECT 1, (SELECT [peak_id] FROM short ORDER BY score DESC, peak_id LIMIT 1)
          UNION ALL SELECT pick + 1, list_append(ids, {W10_PICK}) FROM picks WHERE pick < 20)
        SELECT s.peak_id, s.score, CAST(pick AS INTEGER) AS pick FROM picks JOIN short s ON s.peak_id = ids[pick]""",
        *CVIEWS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf):
    vectors = rounded(L.expected_features(_slot_probs(spark, sf), VECTORS[:2]), 5)
    scores = rounded(L.acquisition(_probs(spark, sf), "hybrid", 0.6))
    return L.diverse_batch(scores, vectors, VECTORS[:2], size=20, pool=60)


@query(
    "A24_uncertainty_totals",
    with_views(f", {TOP_SQL} SELECT round(sum(h), 4) AS entropy, round(sum(fp), 4) AS expected_fp FROM ac", *CVIEWS),
)
def _(spark, sf):
    return rounded(L.uncertainty_totals(_probs(spark, sf), 0.6), 4)


@query(
    "A25_threshold_sweep",
    with_views(
        f""", {TOP_SQL}, th(threshold) AS (VALUES (5e-1), (6e-1), (7e-1), (75e-2), (8e-1), (9e-1)),
        lb2 AS (SELECT peak_id, label FROM sl WHERE slot = 0),
        ct2 AS (SELECT threshold, count(*) AS n, count(*) FILTER (WHERE ts > 0 AND top >= threshold) AS a, count(*) FILTER (WHERE ts > 0 AND top >= threshold AND ts = label) AS tp,
          count(*) FILTER (WHERE ts > 0 AND top >= threshold AND ts <> label) AS fp, count(*) FILTER (WHERE NOT (ts > 0 AND top >= threshold) AND label > 0) AS fn
          FROM ac JOIN lb2 ON ac.peak_id = lb2.peak_id, th GROUP BY 1)
        SELECT threshold, round(tp/(tp + fp), 6) AS precision, round(tp/(tp + fn), 6) AS recall, round(2e0*tp/(2*tp + fp + fn), 6) AS f1, round(a/n, 6) AS assignment_rate FROM ct2""",
        *CVIEWS,
    ),
)
def _(spark, sf):
    labels = _slots(spark, sf).where("slot = 0").select("peak_id", "label")
    return rounded(L.threshold_sweep(_probs(spark, sf), labels))


L4_BATCH = 20


def _answers(slots):
    """What an annotator who knows the truth says: the slot of the true compound, 0 where it is not
    among the candidates, is a decoy or there is none."""
    own = (F.col("slot") > 0) & (F.col("slot") == F.col("label")) & ~F.col("is_decoy")
    return slots.groupBy("peak_id").agg(
        F.first("species").alias("species"), F.coalesce(F.max(F.when(own, F.col("slot"))), F.lit(0)).alias("label"), F.max(F.when(own, F.col("compound_id"))).alias("compound_id")
    )


def _largest_gradient(state):
    """Largest derivative of the posterior at the fitted weights, worked out from the rows again."""
    from peakloom.operators import assignment as A

    fit = state.fit
    p = A.probabilities(state.train, fit["theta"], fit["theta0"], fit["theta_null"])
    off = F.when(F.col("slot") == F.col("label"), 1.0).otherwise(0.0) - F.col("p")
    own = F.col("slot") > 0
    total = lambda c, w: F.abs(F.coalesce(F.sum(c), F.lit(0.0)) - F.lit(w))
    sums = [total(F.when(~own, off), fit["theta_null"]), total(F.when(own, off), fit["theta0"])]
    sums += [total(F.when(own, off * F.col(f)), w) for f, w in fit["theta"].items()]
    return p.agg(F.round(F.greatest(*sums), 3).alias("gradient")).first()["gradient"]


def _plain_metrics(probs, truth, labelled, threshold):
    """Entropy, expected false assignments, precision, recall and F1 straight from their definitions."""
    top = probs.groupBy("peak_id").agg(
        F.sum(-F.greatest("p", F.lit(1e-12)) * F.log(F.greatest("p", F.lit(1e-12)))).alias("h"), F.max("p").alias("p"), F.max_by("slot", F.struct("p", -F.col("slot"))).alias("slot")
    )
    totals = top.agg(F.sum("h").alias("entropy"), F.sum(F.when((F.col("slot") > 0) & (F.col("p") >= threshold), 1 - F.col("p")).otherwise(0.0)).alias("expected_fp")).first()
    judged = truth.join(labelled.select("peak_id"), ["peak_id"], "left_anti")
    chosen = probs.where((F.col("slot") > 0) & (F.col("p") >= threshold)).select("peak_id", "compound_id").join(judged, ["peak_id"])
    hits = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("compound_id") == F.col("true_compound")).alias("tp")).first()
    known = judged.where("true_compound IS NOT NULL").count()
    precision, recall = (hits["tp"] / n if n else 0.0 for n in (hits["n"], known))
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"entropy": totals["entropy"], "expected_fp": totals["expected_fp"], "precision": precision, "recall": recall, "f1": f1}


@query(
    "L4_round_metrics",
    with_views(
        f""", n AS (SELECT count(*) FILTER (WHERE intensity > 1e6) AS seed, least({L4_BATCH}, count(*) FILTER (WHERE intensity <= 1e6)) AS more FROM peaks)
        SELECT CAST(1 AS INTEGER) AS round, 'before' AS stage, seed AS n_labelled, true AS converged, 0e0 AS gradient, 0e0 AS metrics_gap, 0e0 AS prior_gap FROM n
        UNION ALL SELECT 1, 'after', seed + more, true, 0e0, 0e0, 0e0 FROM n""",
        "peaks",
    ),
)
def _(spark, sf):
    """A labelling round on fitted weights: the labels of a batch move the priors and the weights are
    fitted again from the last ones. Reported are the gradient at either optimum, the distance of the
    round's metrics from their definitions and that of the prior's counts from the labels given."""
    truth = _peaks(spark, sf).select("peak_id", "true_compound")
    slots = _slots(spark, sf)
    slots = stored(C.standardise(slots, C.feature_scaler(slots.where("slot > 0 AND NOT is_decoy"))))
    answers = stored(_answers(slots))
    seed = answers.join(_peaks(spark, sf).where("intensity > 1e6").select("peak_id"), ["peak_id"], "left_semi")
    prior, null = PR.batch_update(_labelled(spark, sf))
    first = L.fit_round(slots, stored(seed.select("peak_id", "label")), prior, null, C.FEATURES)
    batch = stored(L.next_batch(first.probs, first.labels, L4_BATCH, "hybrid", 0.6).select("peak_id"))
    given = stored(answers.join(batch, ["peak_id"], "left_semi"))
    second = L.labelling_round(slots, first, given, C.FEATURES)
    metrics = {r["stage"]: r for r in L.round_metrics(first.probs, second.probs, truth, 1, 0.6, labelled=second.labels).collect()}
    mass = lambda s: s.prior.agg(F.sum(F.col("alpha") + F.col("beta") - 2.0)).first()[0] or 0.0
    chosen = given.where("compound_id IS NOT NULL")
    others = slots.where("slot > 0").join(chosen.select("peak_id", F.col("compound_id").alias("own")), ["peak_id"]).where("compound_id <> own").count()
    moved = mass(second) - mass(first) - chosen.count() - PR.NEGATIVE_WEIGHT * others
    rows = []
    for stage, state, prior_gap in (("before", first, 0.0), ("after", second, abs(moved))):
        plain = _plain_metrics(state.probs, truth, second.labels, 0.6)
        gap = max(abs(metrics[stage][k] - v) / max(1.0, abs(v)) for k, v in plain.items())
        rows.append((1, stage, state.labels.count(), bool(state.fit["converged"]), _largest_gradient(state), round(gap, 6) + 0.0, round(prior_gap, 6) + 0.0))
    return spark.createDataFrame(rows, "round int, stage string, n_labelled bigint, converged boolean, gradient double, metrics_gap double, prior_gap double")


# -- embeddings and clusters -----------------------------------------------------------------------


def _chem_embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chem_id"), "embedding", "label")


@query(
    "J19_embedding_lookup",
    """WITH mn AS (SELECT avg(embedding[1]) AS m1, avg(embedding[64]) AS m64 FROM embeddings),
      cp AS (SELECT p_partkey AS comp_id, CASE WHEN p_size = 7 THEN -1 ELSE p_partkey END AS chemical_id FROM part)
    SELECT comp_id, round(coalesce(e.embedding[1] - m1, 0e0), 5) AS z1, round(coalesce(e.embedding[64] - m64, 0e0), 5) AS z64,
      CASE WHEN e.vec_id IS NOT NULL THEN 'embedding' WHEN chemical_id >= 0 THEN 'no embedding' ELSE 'no chemical' END AS z_source
    FROM cp LEFT JOIN embeddings e ON cp.chemical_id = e.vec_id, mn""",
)
def _(spark, sf):
    compounds = table(spark, sf, "part").selectExpr("p_partkey AS comp_id", "CASE WHEN p_size = 7 THEN -1L ELSE p_partkey END AS chemical_id")
    z = E.attach_embeddings(compounds, _chem_embeddings(spark, sf), "embedding")
    return rounded(z.select("comp_id", F.get("z", F.lit(0)).alias("z1"), F.get("z", F.lit(63)).alias("z64"), "z_source"), 5)


def _misplaced(rows, key, x, group):
    """(n_rows, n_misplaced): rows that are closer to the mean of another group than to their own."""
    width = F.posexplode(x).alias("i", "v")
    means = rows.select(group, width).groupBy(group, "i").agg(F.avg("v").alias("m")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    means = means.select(F.col(group).alias("g"), F.transform("m", lambda e: e["m"]).alias("m"))
    centres = F.broadcast(means.agg(F.collect_list(F.struct("g", "m")).alias("c")))  # one row of k centres
    each = rows.join(centres).select(key, group, x.alias("x"), F.explode("c").alias("e"))
    far = F.aggregate(F.zip_with("x", F.col("e.m"), lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda acc, v: acc + v)
    best = each.groupBy(key, group).agg(F.min(far).alias("least"), F.min(F.when(F.col(group) == F.col("e.g"), far)).alias("own"))
    return best.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("n_misplaced"))


@query("M16_chemical_classes", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_misplaced, CAST(32 AS BIGINT) AS n_classes FROM embeddings")
def _(spark, sf):
    """Every chemical is in the class whose mean is nearest."""
    table_ = _chem_embeddings(spark, sf)
    classes, _cost = E.chemical_classes(table_, "embedding", 32)
    rows = table_.join(classes, ["chem_id"])
    n = classes.agg(F.count_distinct("compound_class").alias("n_classes"))
    return _misplaced(rows, "chem_id", F.col("embedding").cast("array<double>"), "compound_class").join(F.broadcast(n))


@query(
    "M17_species_clusters",
    with_views(" SELECT count(DISTINCT species) AS n_rows, CAST(0 AS BIGINT) AS n_misplaced, least(count(DISTINCT species), 5) AS n_classes FROM obs", "obs"),
)
def _(spark, sf):
    """Every species is in the cluster whose mean of the standardised covariates is nearest."""
    names = ["IS1", "RS1", "ES_1"]
    runs = S.run_means(view(spark, sf, "obs"), ["sampleset_id", "worksheet_id", "task_id"], names)
    clusters = E.species_clusters(runs, names, 5)
    means = runs.groupBy("species").agg(*[F.avg(c).alias(c) for c in names])
    scale = means.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]).first()
    x = F.array(*[(F.col(c) - F.lit(scale[f"m_{c}"])) / F.lit(scale[f"s_{c}"]) for c in names])
    n = clusters.agg(F.count_distinct("cluster").alias("n_classes"))
    return _misplaced(means.join(clusters, ["species"]), "species", x, "cluster").join(F.broadcast(n))


@query(
    "M18_whitened_components",
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 0e0 AS mean_i, CASE WHEN i = j THEN 1e0 ELSE 0e0 END AS covariance FROM range(20) a(i), range(20) b(j) WHERE i <= j",
)
def _(spark, sf):
    """Means 0, variances 1 and covariances 0 of the components."""
    z = E.whitened_components(_chem_embeddings(spark, sf), "embedding", 20).select(F.col("embedding20").alias("z"))
    pairs = [(i, j) for i in range(20) for j in range(i, 20)]
    at = lambda i: F.get("z", F.lit(i))
    one = z.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(20)], *[F.covar_samp(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs])
    clean = lambda c: F.round(c, 4) + F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), clean(F.col(f"m{i}")).alias("mean_i"), clean(F.col(f"c{i}_{j}")).alias("covariance")) for i, j in pairs])
    return one.select(F.inline(rows))


@query(
    "M19_rotation_variances",
    with_views(
        """, cv AS (SELECT var_samp(IS1) AS a, covar_samp(IS1, RS1) AS b, var_samp(RS1) AS c FROM obs)
        SELECT round((a + c)/2 + sqrt((a - c)*(a - c)/4 + b*b), 4) AS v1, round(greatest((a*c - b*b)/((a + c)/2 + sqrt((a - c)*(a - c)/4 + b*b)), 0), 4) AS v2 FROM cv""",
        "obs",
    ),
)
def _(spark, sf):
    from peakloom.functions.values import transform_vector

    obs = view(spark, sf, "obs")
    center, rotation = S.feature_transform(obs, ["IS1", "RS1"], "pca")
    x = transform_vector(F.array("IS1", "RS1"), center, rotation)
    t = obs.select(x.alias("x"))
    return rounded(t.agg(F.var_samp(F.get("x", F.lit(0))).alias("v1"), F.var_samp(F.get("x", F.lit(1))).alias("v2")), 4)


# -- curation --------------------------------------------------------------------------------------

# every production row is a peak of its compound in one task; the library time is the prediction
CURATE_SQL = """, cu AS (SELECT sampleset_id AS sample_set_id, worksheet_id*12 + task_id AS task_id, comp_id AS compound_id,
    l_orderkey*1000000 + l_linenumber*100000 + l_partkey AS peak_id, round(rt, 9) AS rt, round(3e0 + 2e-2*comp_id + 1e-1 + 1e-2*species, 9) AS rt_mean, 15e-2 AS half_width FROM obs),
  ins AS (SELECT *, rt_mean - rt AS delta FROM cu WHERE abs(rt - rt_mean) <= half_width),
  cf AS (SELECT sample_set_id, compound_id, quantile_cont(delta, 0.5) AS correction FROM ins GROUP BY 1, 2),
  mv AS (SELECT ins.*, correction, abs(delta - correction) AS off, row_number() OVER (PARTITION BY ins.sample_set_id, ins.task_id, ins.compound_id ORDER BY abs(delta - correction), peak_id) AS rn
    FROM ins JOIN cf ON ins.sample_set_id = cf.sample_set_id AND ins.compound_id = cf.compound_id),
  se AS (SELECT * FROM mv WHERE rn = 1 AND off <= 2e-2)"""


def _selected(spark, sf):
    def build():
        cu = view(spark, sf, "obs").selectExpr(
            "sampleset_id AS sample_set_id", "worksheet_id*12 + task_id AS task_id", "comp_id AS compound_id",
            "l_orderkey*1000000 + l_linenumber*100000 + l_partkey AS peak_id", "round(rt, 9) AS rt",
            "round(3e0 + 2e-2*comp_id + 1e-1 + 1e-2*species, 9) AS rt_mean", "15e-2 AS half_width",
        )
        return U.select_peaks(cu)

    return kept(spark, sf, "selected", build)


@query(
    "W13_correction_factor_selection",
    with_views(CURATE_SQL + " SELECT sample_set_id, task_id, compound_id, round(correction, 6) AS correction, round(off, 6) AS offset FROM se".replace(" AS offset", ' AS "offset"'), "obs"),
)
def _(spark, sf):
    return rounded(_selected(spark, sf).select("sample_set_id", "task_id", "compound_id", "correction", "offset"))


@query(
    "M20_coherence_scores",
    with_views(
        CURATE_SQL + """, z AS (SELECT *, half_width/1.959963984540054e0 AS sg, (delta - correction)/(half_width/1.959963984540054e0) AS zz FROM se)
        SELECT sample_set_id, compound_id, round(avg(-5e-1*(zz*zz + ln(sg*sg))), 5) AS x, count(*) AS n_tasks FROM z GROUP BY 1, 2""",
        "obs",
    ),
)
def _(spark, sf):
    return rounded(U.coherence_scores(_selected(spark, sf)), 5)


@query(
    "M20_coherence_mixture",
    with_views(
        CURATE_SQL + " SELECT sample_set_id, count(DISTINCT compound_id) AS n, true AS converged, 0e0 AS residual FROM se GROUP BY 1",
        "obs",
    ),
)
def _(spark, sf):
    """How far one more round from the scores would move weights and means: nowhere."""
    scores = U.coherence_scores(_selected(spark, sf))
    mix = stored(U.coherence_mixture(scores))
    first = F.col("coherent_component") == 1
    r = F.when(first, F.col("posterior_coherent")).otherwise(1.0 - F.col("posterior_coherent"))
    sums = mix.withColumn("r", r).groupBy("sample_set_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("converged").alias("converged"), F.sum("r").alias("n1"), F.sum(1 - F.col("r")).alias("n0"),
        F.sum(F.col("r") * F.col("x")).alias("s1"), F.sum((1 - F.col("r")) * F.col("x")).alias("s0"), *[F.max(c).alias(c) for c in ("mu0", "mu1", "w0", "w1")],
    )
    part = lambda k: F.when(F.col(f"n{k}") > 1e-6, F.abs(F.col(f"s{k}") / F.col(f"n{k}") - F.col(f"mu{k}"))).otherwise(0.0)
    weight = lambda k: F.abs((F.col(f"n{k}") + U.WEIGHT_PRIOR) / (F.col("n") + 2 * U.WEIGHT_PRIOR) - F.col(f"w{k}"))
    return sums.select("sample_set_id", "n", "converged", F.round(F.greatest(part(0), part(1), weight(0), weight(1)), 4).alias("residual"))


# -- pooled and lasso models -----------------------------------------------------------------------


def _pooled(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _pool:
        coef, state = PO.train_partial_pool(_fold(spark, sf, "train"), FEATURES)
        _pool[key] = (kept(spark, sf, "pooled", lambda: coef), state)
    return _pool[key]


_pool: dict = {}


def _pool_residual(rows, coef, state):
    """(species, comp_id, n, converged, residual): largest gradient of each group's posterior per row,
    worked out from its rows; zero at the optimum."""
    x = [F.col(f) - F.lit(c) for f, c in zip(state.features, state.center)]
    at = lambda i: F.get("beta_hat", F.lit(i))
    error = F.col("rt") - at(0)
    for i, v in enumerate(x):
        error = error - at(i + 1) * v
    sums = rows.join(coef.select("species", "comp_id", "beta_hat"), ["species", "comp_id"]).groupBy("species", "comp_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(error).alias("g0"), *[F.sum(error * v).alias(f"g{i + 1}") for i, v in enumerate(x)], F.any_value("beta_hat").alias("beta_hat")
    )
    sums = sums.join(state.species.select("species", "mu", "slopes"), ["species"]).join(state.compounds.select("comp_id", "alpha"), ["comp_id"])
    ratio = state.sigma2 / state.tau_b2
    gradients = [F.abs(F.col("g0") - F.lit(ratio) * (at(0) - F.lit(state.t0) - F.col("mu") - F.col("alpha")))]
    gradients += [F.abs(F.col(f"g{i + 1}") - F.lit(state.penalty) * (at(i + 1) - F.get("slopes", F.lit(i)))) for i in range(len(x))]
    return sums.select("species", "comp_id", "n", F.lit(state.converged).alias("converged"), F.round(F.greatest(*gradients) / F.col("n"), 5).alias("residual"))


@query(
    "M10_partial_pooling",
    with_views(" SELECT species, comp_id, count(*) AS n, true AS converged, 0e0 AS residual FROM obs WHERE fold = 'train' GROUP BY 1, 2", "obs"),
)
def _(spark, sf):
    return _pool_residual(_fold(spark, sf, "train"), *_pooled(spark, sf))


FACADE = FIT.format(keys="species, comp_id") + """, te AS (SELECT * FROM obs WHERE fold = 'test'),
  sc AS (SELECT te.species, b + w*IS1 - rt AS err FROM te JOIN m ON te.species = m.species AND te.comp_id = m.comp_id)"""


@query(
    "M11_model_facade",
    with_views(
        FACADE + """ SELECT k.mode, (SELECT count(*) FROM te) AS n_test, count(*) AS n_used, CASE WHEN k.mode <> 'partial_pool' THEN round(sqrt(avg(err*err)), 5) END AS rmse,
        CASE WHEN k.mode <> 'partial_pool' THEN round(avg(abs(err)), 5) END AS mae, CASE WHEN k.mode = 'partial_pool' THEN 0e0 END AS residual FROM sc, (VALUES ('group_ridge'), ('shared_noise_ridge'), ('partial_pool')) k(mode) GROUP BY 1""",
        "obs",
    ),
)
def _(spark, sf):
    """All modes of the entry point on the same rows. The pooled model has no closed form: instead of its
    errors the largest gradient of its posterior is reported, worked out from the rows again."""
    rows, test = _fold(spark, sf, "train"), _fold(spark, sf, "test")
    out = []
    for mode in ("group_ridge", "shared_noise_ridge", "partial_pool"):
        coef, settings = R.fit(rows, ["IS1"], mode, group="species", penalty=1e-3)
        center = settings.center if mode == "partial_pool" else settings["center"]
        m = M.overall(SC.score(test, coef, ["IS1"], "species", center=center))
        residual = F.lit(None).cast("double")
        if mode == "partial_pool":
            residual = F.lit(_pool_residual(rows, coef, settings).agg(F.max("residual")).first()[0])
        out.append(m.withColumns({"mode": F.lit(mode), "residual": residual}))
    both = out[0].unionByName(out[1]).unionByName(out[2])
    closed = F.col("mode") != "partial_pool"
    return rounded(both.select("mode", "n_test", "n_used", F.when(closed, F.col("rmse")).alias("rmse"), F.when(closed, F.col("mae")).alias("mae"), "residual"), 5)


def _backoff_gap(rows, state, keys):
    """Rows scored from hierarchy effects alone, by ``keys``: how many, and how far the scores are from
    the effects written out per group, joined from the fitted tables without the scorer."""
    rows = rows.withColumns({f: F.col(f) - F.lit(c) for f, c in zip(state.features, state.center)})
    species, compounds, t0 = state.backoff()
    pred = SC.score_backoff(rows, species, compounds, state.features, t0, clusters=state.cluster_effects())
    groups = rows.select("species", "species_cluster", "comp_id").distinct()
    own = state.species.select("species", F.col("mu").alias("m1"), F.col("slopes").alias("w1"))
    shared = state.species.groupBy("species_cluster").agg(F.avg("mu").alias("m2"), *[F.avg(F.get("slopes", F.lit(i))).alias(f"v{i}") for i in range(len(state.features))])
    plain = groups.join(own, ["species"], "left").join(shared, ["species_cluster"], "left").join(state.compounds.select("comp_id", "alpha"), ["comp_id"], "left")
    level = F.lit(t0) + F.coalesce("m1", "m2", F.lit(0.0)) + F.coalesce("alpha", F.lit(0.0))
    slopes = [F.coalesce(F.get("w1", F.lit(i)), F.col(f"v{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(len(state.features))]
    both = pred.join(plain.select("species", "comp_id", level.alias("level0"), *slopes), ["species", "comp_id"])
    want = F.col("level0")
    for i, f in enumerate(state.features):
        want = want + F.col(f"w{i}") * F.col(f)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("pred_mean") - want)), 8).alias("gap"))


@query(
    "M14_backoff_scoring",
    with_views(" SELECT species, count(*) AS n, 0e0 AS gap FROM obs WHERE fold = 'test' GROUP BY 1", "obs"),
)
def _(spark, sf):
    """Test rows scored from hierarchy effects alone, as if their groups were unseen."""
    return _backoff_gap(_fold(spark, sf, "test"), _pooled(spark, sf)[1], ["species"])


def _backoff(mode):
    """Rows of held-out groups scored from a model that never saw them; ``effect_of`` says whose effect
    stood in for the species."""

    def run(spark, sf):
        train, held = P.unseen_group_split(view(spark, sf, "obs"), mode)
        _, state = PO.train_partial_pool(train, FEATURES)
        return _backoff_gap(held, state, ["species", "effect_of"]).withColumn("converged", F.lit(state.converged))

    return run


def _backoff_sql(mode):
    level = {"species": "cluster", "pair": "species"}[mode]
    return f"""SELECT species, '{level}' AS effect_of, CAST(sum(n_rows) AS BIGINT) AS n, true AS converged, 0e0 AS gap
      FROM ({_unseen_sql(mode)}) q WHERE part = 'held' GROUP BY 1"""


query("M14_backoff_unseen_species", _backoff_sql("species"))(_backoff("species"))
query("M14_backoff_unseen_pairs", _backoff_sql("pair"))(_backoff("pair"))


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "sampleset_id"]


def _lasso_residual(rows, models, keys, features):
    """(keys, n, residual): how far each group is from the optimality conditions of its penalty."""
    joined = rows.join(models.select(*keys, "intercept", "coef", "alpha", "converged"), list(keys))
    error = F.col("rt") - F.col("intercept")
    for i, f in enumerate(features):
        error = error - F.get("coef", F.lit(i)) * F.col(f)
    sums = joined.groupBy(*keys, "alpha", "converged", "coef").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("e"), *[F.avg(error * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)],
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
    )
    gaps = [F.abs(F.col("e"))]
    for i in range(len(features)):
        w, s = F.get("coef", F.lit(i)), F.col(f"s{i}")
        g = (F.col(f"g{i}") - F.col("e") * F.col(f"m{i}")) / s
        gaps.append(F.when(s < 1e-9, 0.0).when(F.abs(w) > 1e-12, F.abs(g - F.col("alpha") * F.signum(w))).otherwise(F.greatest(F.abs(g) - F.col("alpha"), F.lit(0.0))))
    return sums.select(*keys, "n", "converged", F.round(F.greatest(*gaps), 5).alias("residual"))


def _lasso_sql(keys):
    return with_views(f" SELECT {keys}, count(*) AS n, true AS converged, 0e0 AS residual FROM obs WHERE fold = 'train' GROUP BY ALL HAVING count(*) >= 3", "obs")


def _lasso(keys):
    def run(spark, sf):
        train = _fold(spark, sf, "train")
        return _lasso_residual(train, stored(LA.fit_lasso(train, keys, ["IS1", "RS1"], ROW_KEY)), keys, ["IS1", "RS1"])

    return run


query("M15_lasso_species_compound", _lasso_sql("species, comp_id"))(_lasso(["species", "comp_id"]))
query("M15_lasso_cluster_compound", _lasso_sql("species_cluster, comp_id"))(_lasso(["species_cluster", "comp_id"]))


@query("M15_lasso_cluster_profile", _lasso_sql("species_cluster"))
def _(spark, sf):
    train = _fold(spark, sf, "train")
    runs = S.run_means(train, ["sampleset_id", "worksheet_id", "task_id"], ["IS1", "RS1"])
    rows = stored(LA.with_species_profile(train, runs, ["IS1", "RS1"]))
    return _lasso_residual(rows, stored(LA.fit_lasso(rows, ["species_cluster"], ["IS1", "RS1"], ROW_KEY)), ["species_cluster"], ["IS1", "RS1"])
