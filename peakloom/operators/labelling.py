"""Choosing peaks to label: acquisition scores, batches, diversity, round metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.values import entropy_term
from peakloom.operators import presence as PR
from peakloom.plans.durable import discard, stored
from peakloom.plans.joins import grown_join, lookup_join

ACQUISITIONS = ("fp", "entropy", "lc", "margin", "mi", "hybrid")


def peak_summary(probs: DataFrame) -> DataFrame:
    """(peak_id, top, top_slot, second, entropy): the two best slots of a peak and its uncertainty."""
    place = F.row_number().over(Window.partitionBy("peak_id").orderBy(F.desc("p"), "slot"))
    at = lambda i, c: F.max(F.when(F.col("_place") == i, F.col(c)))
    return probs.select("peak_id", "slot", "p", place.alias("_place")).groupBy("peak_id").agg(
        at(1, "p").alias("top"), at(1, "slot").alias("top_slot"), at(2, "p").alias("second"), F.sum(entropy_term("p")).alias("entropy")
    )


def expected_fp_term(threshold: float) -> Column:
    """1 - top probability of peaks that would be assigned, else zero."""
    return F.when((F.col("top_slot") > 0) & (F.col("top") >= threshold), 1.0 - F.col("top")).otherwise(0.0)


def mutual_information(samples: DataFrame) -> DataFrame:
    """(peak_id, score): entropy of the mean prediction minus the mean entropy of the draws."""
    mean = samples.groupBy("peak_id", "slot").agg(F.avg("p").alias("p"), F.sum(entropy_term("p")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return mean.groupBy("peak_id").agg((F.sum(entropy_term("p")) - F.sum(F.col("_h") / F.col("_n"))).alias("score"))


def acquisition(
    probs: DataFrame, name: str = "hybrid", threshold: float = 0.75, lambda_fp: float = 0.7,
    samples: DataFrame | None = None,
) -> DataFrame:
    """(peak_id, score) under the named acquisition function."""
    if name not in ACQUISITIONS:
        raise ValueError(f"unknown acquisition function {name!r}; choose from {ACQUISITIONS}")
    if name == "mi":
        if samples is None:
            raise ValueError("mi needs probability samples")
        return mutual_information(samples)
    fp = expected_fp_term(threshold)
    score = {
        "fp": fp,
        "entropy": F.col("entropy"),
        "lc": 1.0 - F.col("top"),
        "margin": F.coalesce(-(F.col("top") - F.col("second")), F.lit(0.0)),
        "hybrid": lambda_fp * fp + (1.0 - lambda_fp) * F.col("entropy"),
    }[name]
    return peak_summary(probs).select("peak_id", score.alias("score"))


def select_batch(scores: DataFrame, size: int) -> DataFrame:
    """The ``size`` highest scores, ties to the smallest peak (a top-k report)."""
    return scores.orderBy(F.desc("score"), "peak_id").limit(size)


def expected_features(slots: DataFrame, features: Sequence[str], p: str = "p") -> DataFrame:
    """Probability-weighted mean features over the non-null candidates; zeros without candidates."""
    w = F.when(F.col("slot") > 0, F.col(p)).otherwise(0.0)
    total = F.sum(w) + F.lit(1e-12)
    return slots.groupBy("peak_id").agg(
        *[F.coalesce(F.sum(w * F.coalesce(F.col(f), F.lit(0.0))) / total, F.lit(0.0)).alias(f) for f in features]
    )


def diverse_batch(scores: DataFrame, vectors: DataFrame, features: Sequence[str], size: int, pool: int) -> DataFrame:
    """(peak_id, score, pick): farthest-point selection from the ``pool`` best peaks, starting at the
    best one; ties go to the higher score, then to the smaller peak. A pool of at most ``size``
    peaks is taken whole, by score.

    The pool is a table. Each pick lowers every peak's distance to the batch and takes the largest
    one by an aggregation; only the picked peak itself reaches the driver.
    """
    if pool <= 0 or size <= 0:
        raise ValueError("size and pool must be positive")
    spark = scores.sparkSession
    short = select_batch(scores, pool).join(vectors.select("peak_id", F.array(*[F.col(f).cast("double") for f in features]).alias("x")), ["peak_id"])
    left = stored(short.select("peak_id", "score", "x", F.lit(None).cast("double").alias("gap")))
    kind = "peak_id long, score double, pick int"
    if left.count() <= size:
        rows = [tuple(r) for r in left.select("peak_id", "score").orderBy(F.desc("score"), "peak_id").collect()]
        return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], kind)
    chosen = []
    while len(chosen) < size:
        best = left.agg(F.max(F.struct("gap", "score", (-F.col("peak_id")).alias("neg"), "x")).alias("b")).first()["b"]
        chosen.append((-best["neg"], best["score"], len(chosen) + 1))
        to = F.array(*[F.lit(v) for v in best["x"]])
        squares = F.zip_with("x", to, lambda a, c: (a - c) * (a - c))
        far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
        last = left
        left = stored(last.where(F.col("peak_id") != F.lit(-best["neg"])).withColumn("gap", F.least("gap", far)))
        discard(last)
    discard(left)
    return spark.createDataFrame(chosen, kind)


def next_batch(
    probs: DataFrame, history: DataFrame | None, size: int, name: str = "hybrid", threshold: float = 0.75,
    lambda_fp: float = 0.7, samples: DataFrame | None = None, vectors: DataFrame | None = None,
    features: Sequence[str] = (), pool: int | None = None,
) -> DataFrame:
    """The next peaks to label, peaks already in ``history`` excluded."""
    scores = acquisition(probs, name, threshold, lambda_fp, samples)
    if history is not None:
        scores = scores.join(history.select("peak_id").distinct(), ["peak_id"], "left_anti")
    if pool is None or vectors is None:
        return select_batch(scores, size)
    return diverse_batch(scores, vectors, features, size, pool)


def uncertainty_totals(probs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Total entropy and expected number of false assignments."""
    return peak_summary(probs).agg(F.sum("entropy").alias("entropy"), F.sum(expected_fp_term(threshold)).alias("expected_fp"))


def threshold_sweep(
    probs: DataFrame, labels: DataFrame, thresholds: Sequence[float] = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9)
) -> DataFrame:
    """Precision, recall, F1 and assignment rate per threshold, all thresholds in one pass.

    ``labels`` holds (peak_id, label) with slot numbers; an assignment to a wrong class counts as
    a false positive only.
    """
    top = grown_join(peak_summary(probs).select("peak_id", "top", "top_slot"), labels, ["peak_id"])
    aggs = []
    for i, t in enumerate(thresholds):
        made = (F.col("top_slot") > 0) & (F.col("top") >= t)
        right = F.col("top_slot") == F.col("label")
        aggs += [
            F.count_if(made & right).alias(f"tp{i}"), F.count_if(made & ~right).alias(f"fp{i}"),
            F.count_if(~made & (F.col("label") > 0)).alias(f"fn{i}"), F.count_if(made).alias(f"a{i}"),
        ]
    one = top.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                F.col(f"fn{i}").alias("fn"), F.col(f"a{i}").alias("assigned"), F.col("n"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    long = one.select(F.inline(rows)).withColumns(
        {"precision": zero(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    p, r = F.col("precision"), F.col("recall")
    return long.select(
        "threshold", "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        zero(F.col("assigned"), F.col("n")).alias("assignment_rate"),
    )


def round_metrics(
    before: DataFrame, after: DataFrame, truth: DataFrame, round_no: int, threshold: float = 0.75, labelled: DataFrame | None = None
) -> DataFrame:
    """Uncertainty and accuracy before and after a labelling round, one row per stage. Peaks in
    ``labelled`` count for the uncertainty, but not for the accuracy of either stage."""
    from peakloom.operators.assignment import evaluate

    rows = []
    for stage, probs in (("before", before), ("after", after)):
        left = uncertainty_totals(probs, threshold).withColumn("_k", F.lit(1))
        right = evaluate(probs, truth, threshold=threshold, labelled=labelled).select("precision", "recall", "f1", "ece", F.lit(1).alias("_k"))
        rows.append(left.join(right, ["_k"]).drop("_k").select(F.lit(round_no).alias("round"), F.lit(stage).alias("stage"), "*"))
    return rows[0].unionByName(rows[1])


# -- labelling rounds ------------------------------------------------------------------------------


@dataclass
class RoundState:
    """What a labelling round starts from and leaves behind.

    ``prior`` holds (species, compound_id, alpha, beta), ``null`` the one row of the null class,
    ``labels`` (peak_id, label) of all peaks labelled so far, ``train`` the slots the weights were
    fitted on, ``fit`` these weights and ``probs`` the slots with their probabilities.
    """

    prior: DataFrame
    null: DataFrame
    labels: DataFrame
    train: DataFrame
    fit: Mapping[str, object]
    probs: DataFrame


def fit_round(
    slots: DataFrame, labels: DataFrame, prior: DataFrame, null: DataFrame, features: Sequence[str], last: Mapping[str, object] | None = None
) -> RoundState:
    """Fit the assignment weights on the labelled peaks, from the ``last`` weights if there are any.

    ``slots`` holds peak_id, slot, species, compound_id, is_decoy and the scaled features; a label is
    the slot of the compound, 0 for none of them. Decoys take no part in the fit, but get a probability.
    """
    from peakloom.operators import assignment as A

    scored = A.with_log_prior(slots.drop("label", "log_pi"), prior, PR.log_null(null))
    known = lookup_join(scored, labels.select("peak_id", "label"), ["peak_id"], "inner")
    train = stored(known.where("slot = 0 OR NOT is_decoy").withColumns({f: F.coalesce(f, F.lit(0.0)) for f in features}))
    fit = A.fit_weights(train, features, start=last)
    filled = scored.withColumns({f: F.coalesce(f, F.lit(0.0)) for f in features})
    return RoundState(prior, null, labels, train, fit, stored(A.probabilities(filled, fit["theta"], fit["theta0"], fit["theta_null"])))


def labelling_round(slots: DataFrame, state: RoundState, answers: DataFrame, features: Sequence[str], smoothing: float = 1.0) -> RoundState:
    """One round: new ``answers`` (peak_id, species, label, compound_id) move the priors, join the labels
    and the weights are fitted again from where they were.

    A chosen compound gains in the prior of its species, the peak's other candidates are lightly
    rejected, an answer without a compound counts for the null class. A peak that had a label keeps it.
    """
    fresh = stored(answers.join(state.labels.select("peak_id"), ["peak_id"], "left_anti").dropDuplicates(["peak_id"]))
    events = stored(PR.label_events(fresh, slots.where("slot > 0").select("peak_id", "compound_id")))
    prior = stored(PR.apply_events(state.prior, events, smoothing))
    null = stored(PR.apply_null_events(state.null, events))
    labels = stored(state.labels.select("peak_id", "label").unionByName(fresh.select("peak_id", "label")))
    return fit_round(slots, labels, prior, null, features, state.fit)
