"""Softmax probabilities over candidates, assignment, and its evaluation.

Everything is keyed by peak. A peak's slots are few (bounded by the compounds inside its mass
and time windows), so windows over one peak are small whatever the size of the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.values import log_prior
from peakloom.operators.metrics import (
    brier,
    expected_calibration_error,
    macro_calibration_error,
)
from peakloom.plans.durable import discard, stored
from peakloom.plans.joins import GROWING_BYTES, grown_join, lookup_join

# Draws evaluated together; more of them take several rounds over the slots.
DRAW_BLOCK = 20_000
# Logits a task works out at a time.
_LOGITS = 1_000_000


def with_log_prior(slots: DataFrame, prior: DataFrame, log_null: float, smoothing: float = 1.0) -> DataFrame:
    """log pi of every slot; compounds without a prior row have the smoothing prior."""
    p = prior.select("species", "compound_id", log_prior("alpha", "beta").alias("_lp"))
    default = F.lit(math.log(0.5)) if smoothing > 0 else F.lit(0.0)
    joined = lookup_join(slots, p, ["species", "compound_id"], "left", max_bytes=GROWING_BYTES)
    return joined.withColumn(
        "log_pi", F.when(F.col("slot") == 0, F.lit(log_null)).otherwise(F.coalesce("_lp", default))
    ).drop("_lp")


def _logit(theta: Mapping[str, float], theta0: float, theta_null: float) -> Column:
    acc = F.lit(float(theta0))
    for f, w in theta.items():
        acc = acc + F.lit(float(w)) * F.col(f)
    return F.when(F.col("slot") == 0, F.lit(float(theta_null))).otherwise(acc) + F.col("log_pi")


def softmax(rows: DataFrame, logit: str, keys: Sequence[str] = ("peak_id",), out: str = "p") -> DataFrame:
    """Max-shifted softmax within ``keys``."""
    group = Window.partitionBy(*keys)
    shifted = rows.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(group)))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def probabilities(
    slots: DataFrame, theta: Mapping[str, float], theta0: float = 0.0, theta_null: float = 0.0
) -> DataFrame:
    """Slots with ``p`` for one parameter vector; needs ``log_pi``."""
    return softmax(slots.withColumn("_logit", _logit(theta, theta0, theta_null)), "_logit").drop("_logit")


def draw_table(slots: DataFrame, draws: Sequence[Mapping[str, object]] | DataFrame) -> DataFrame:
    """(draw, theta0, theta_null, sigma, w): parameter draws as a table, weights by feature name."""
    if isinstance(draws, DataFrame):
        return draws.select("draw", "theta0", "theta_null", "sigma", "w")
    if not len(draws):
        raise ValueError("at least one draw is needed")
    rows = [
        (i, float(d["theta0"]), float(d["theta_null"]), float(d.get("sigma_logit", 0.0)), {k: float(v) for k, v in d["theta"].items()})
        for i, d in enumerate(draws)
    ]
    return slots.sparkSession.createDataFrame(rows, "draw int, theta0 double, theta_null double, sigma double, w map<string,double>")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Positions at which any of the sorted columns has a new value, null being one."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut between peaks."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        at = int(_starts(batch.column("peak_id"))[-1])
        ends = len(held) > 1 and len(_starts(pa.concat_arrays([held[0].column("peak_id").slice(0, 1), batch.column("peak_id").slice(0, 1)]))) > 1
        if at or ends:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)]).combine_chunks()
            held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _uniform(keys: list[bytes], ends: list[bytes]) -> np.ndarray:
    """values.hash_fraction of every key with every ending."""
    md5 = hashlib.md5
    digits = b"".join([md5(k + e, usedforsecurity=False).digest()[:6] for k in keys for e in ends])
    return np.frombuffer(digits, np.uint8).reshape(len(keys), len(ends), 6) @ 256.0 ** np.arange(-1, -7, -1)


def _drawn(slots: DataFrame, draws: DataFrame, noise_seed: int | None, mean: bool) -> DataFrame:
    """(peak_id, slot, compound_id, draw, p) or, as ``mean``, (peak_id, slot, compound_id, p, n): the sum
    over the draws and their number, rows that repeat added up.

    The slots are dealt by peak once; a task takes whole peaks and evaluates all draws for them, so
    nothing is shuffled per slot and draw. A null in a peak's logits makes its probabilities null.
    """
    table = draws.collect()  # a block of parameter vectors
    features = sorted({f for r in table for f in (r["w"] or {})})
    number = lambda name: np.array([np.nan if r[name] is None else r[name] for r in table], dtype=float)
    absent = lambda name: np.array([r[name] is None for r in table], dtype=bool)
    theta0, theta_null, sigma = number("theta0"), number("theta_null"), number("sigma")
    no0, no_null, no_sigma = absent("theta0"), absent("theta_null"), absent("sigma") & (noise_seed is not None)
    weights = np.array([[(r["w"] or {}).get(f) or 0.0 for r in table] for f in features], dtype=float).reshape(len(features), len(table))
    names = [r["draw"] for r in table]
    ends = [[f"|{'~' if d is None else d}|{noise_seed + i}".encode() for d in names] for i in (0, 1)] if noise_seed is not None else []
    draw_type = draws.schema["draw"].dataType.simpleString()
    kind = {f.name: f.dataType.simpleString() for f in slots.schema.fields}
    own = ", ".join(f"{c} {kind[c]}" for c in ("peak_id", "slot", "compound_id"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("peak_id", "slot")]
    used = slots.select(
        "peak_id", "slot", "compound_id", F.col("log_pi").cast("double").alias("_prior"),
        *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
        *([F.concat_ws("|", *text).cast("binary").alias("_key")] if noise_seed is not None else []),
    ).repartition("peak_id").sortWithinPartitions("peak_id", "slot", "compound_id")

    def run(batches):
        for t in _whole_peaks(batches):
            get = lambda name: t.column(name).chunk(0)
            value = lambda c: pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False)
            null = pc.equal(get("slot"), 0).fill_null(False).to_numpy(zero_copy_only=False)
            xs = [get(f"_x{i}") for i in range(len(features))]
            x = np.column_stack([value(c) for c in xs]) if xs else np.zeros((len(null), 0))
            lost = get("_prior").is_null().to_numpy(zero_copy_only=False)
            for c in xs:
                lost = lost | (~null & c.is_null().to_numpy(zero_copy_only=False))
            prior, keys = value(get("_prior")), get("_key").to_pylist() if noise_seed is not None else []
            peaks = _starts(get("peak_id"))
            of = np.repeat(np.arange(len(peaks)), np.diff([*peaks, len(null)]))
            same = _starts(get("peak_id"), get("slot"), get("compound_id"))
            total, some = np.zeros(len(same)), np.zeros(len(same), dtype=bool)
            step = max(1, _LOGITS // len(null))
            for lo in range(0, len(names), step):
                cut = slice(lo, lo + step)
                logit = np.where(null[:, None], theta_null[cut], theta0[cut] + np.where(null[:, None], 0.0, x) @ weights[:, cut]) + prior[:, None]
                if noise_seed is not None:
                    u1, u2 = (_uniform(keys, e[cut]) for e in ends)
                    logit += sigma[cut] * np.sqrt(-2.0 * np.log(np.maximum(u1, 1e-12))) * np.cos(2 * math.pi * u2)
                bad = lost[:, None] | np.where(null[:, None], no_null[cut], no0[cut]) | no_sigma[cut]
                bad = np.logical_or.reduceat(bad, peaks, axis=0)[of]
                with np.errstate(invalid="ignore"):
                    e = np.exp(logit - np.maximum.reduceat(logit, peaks, axis=0)[of])
                    p = e / np.add.reduceat(e, peaks, axis=0)[of]
                if mean:
                    total += np.add.reduceat(np.where(bad, 0.0, p).sum(axis=1), same)
                    some |= np.logical_or.reduceat(~bad.all(axis=1), same)
                    continue
                rows = pa.array(np.repeat(np.arange(len(null)), p.shape[1]))
                draw = pa.array(names[cut], t_draw).take(pa.array(np.tile(np.arange(p.shape[1]), len(null))))
                cols = [*[get(c).take(rows) for c in ("peak_id", "slot", "compound_id")], draw, pa.array(p.ravel(), mask=bad.ravel())]
                yield from pa.Table.from_arrays(cols, names=["peak_id", "slot", "compound_id", "draw", "p"]).to_batches(max_chunksize=65_536)
            if mean and names:
                n = np.diff([*same, len(null)]) * len(names)
                cols = [*[get(c).take(pa.array(same)) for c in ("peak_id", "slot", "compound_id")], pa.array(total, mask=~some), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["peak_id", "slot", "compound_id", "p", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    t_draw = to_arrow_type(draws.schema["draw"].dataType)
    return used.mapInArrow(run, f"{own}, p double, n bigint" if mean else f"{own}, draw {draw_type}, p double")


def draw_probabilities(
    slots: DataFrame, draws: Sequence[Mapping[str, object]] | DataFrame, noise_seed: int | None = None
) -> DataFrame:
    """(peak_id, slot, compound_id, draw, p), one softmax per parameter draw.

    With a seed, Normal noise of each draw's deviation is added; it is a function of (peak, slot,
    draw), so a recomputed partition gets the same noise.
    """
    return _drawn(slots, draw_table(slots, draws), noise_seed, mean=False)


def mean_draw_probabilities(
    slots: DataFrame, draws: Sequence[Mapping[str, object]] | DataFrame, noise_seed: int | None = None, block: int = DRAW_BLOCK
) -> DataFrame:
    """(peak_id, slot, compound_id, p): the mean over any number of draws, without a row per slot and
    draw leaving its task. Draws are taken ``block`` at a time and their sums added."""
    table = draw_table(slots, draws)
    if not isinstance(draws, DataFrame):
        groups = -(-len(draws) // block)
        parts = [table.where(F.floor(F.col("draw") / block) == g) for g in range(groups)]
    else:
        groups = -(-table.count() // block)
        # the draws are dealt out by a hash; each group is about a block
        parts = [table.where(F.pmod(F.xxhash64("draw"), F.lit(groups)) == g) for g in range(groups)]
    sums = None
    for part in parts:
        each = _drawn(slots, part, noise_seed, mean=True)
        sums = each if sums is None else stored(sums.unionAll(each).groupBy("peak_id", "slot", "compound_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    return sums.select("peak_id", "slot", "compound_id", (F.col("p") / F.col("n")).alias("p"))


def mean_probabilities(samples: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Average over draws, renormalised per peak."""
    used = samples if max_samples is None else samples.where(F.col("draw") < max_samples)
    mean = used.groupBy("peak_id", "slot", "compound_id").agg(F.avg("p").alias("p"))
    return mean.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("peak_id")))


# -- fitting the weights -----------------------------------------------------------------------


def fit_weights(
    slots: DataFrame, features: Sequence[str], iterations: int = 200, tolerance: float = 1e-6,
    start: Mapping[str, object] | None = None,
) -> dict[str, object]:
    """Maximum a posteriori weights of the conditional logit, with N(0, 1) priors.

    ``slots`` needs log_pi, label and the features; only peaks with ``label >= 0`` contribute.
    Each Newton step is one pass: every task reduces its peaks to a gradient and a Hessian, and
    only those small matrices are added up. Runs until the step is below ``tolerance``; ``converged``
    is false when ``iterations`` steps were not enough. ``objective`` belongs to the returned weights;
    ``start`` takes weights returned before, from which the steps go on; ``iterations`` counts them.
    """
    names = ["theta_null", "theta0", *features]
    d = len(names)
    # one row per peak and slot, kept in peak order inside a partition
    used = stored(
        slots.where("label >= 0")
        .select("peak_id", "slot", "label", "log_pi", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features])
        .repartition("peak_id").sortWithinPartitions("peak_id", "slot")
    )
    w, converged, steps = np.zeros(d), False, 0
    if start is not None:
        w = np.array([start["theta_null"], start["theta0"], *[start["theta"][f] for f in features]], dtype=float)
    total = _newton_sums(used, features, w)
    for steps in range(1, iterations + 1):
        grad = total[1 : 1 + d] - w
        hess = total[1 + d :].reshape(d, d) + np.eye(d)
        step = np.linalg.solve(hess, grad)
        w = w + step
        total = _newton_sums(used, features, w)
        converged = bool(np.abs(step).max() < tolerance)
        if converged:
            break
    discard(used)
    return {
        "theta_null": float(w[0]), "theta0": float(w[1]), "theta": {f: float(v) for f, v in zip(features, w[2:], strict=True)},
        "objective": total[0] - 0.5 * float(w @ w), "converged": converged, "iterations": steps,
    }


def _newton_sums(used: DataFrame, features: Sequence[str], w: np.ndarray) -> np.ndarray:
    """[log-likelihood, gradient, flattened information] at ``w``."""
    names = list(features)
    d = len(names) + 2

    def reduce(batches):
        total = np.zeros(1 + d + d * d)
        carry = None
        for pdf in batches:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            # the last peak may continue in the next batch
            last = pdf["peak_id"].iloc[-1]
            carry = pdf[pdf["peak_id"] == last]
            total += add(pdf[pdf["peak_id"] != last])
        if carry is not None:
            total += add(carry)
        yield pd.DataFrame({"i": np.arange(total.size), "v": total})

    def add(pdf):
        out = np.zeros(1 + d + d * d)
        if not len(pdf):
            return out
        null = (pdf["slot"] == 0).to_numpy(float)
        x = np.column_stack([null, 1.0 - null, pdf[names].to_numpy(float) * (1.0 - null)[:, None]])
        eta = x @ w + pdf["log_pi"].to_numpy(float)
        _, at = np.unique(pdf["peak_id"].to_numpy(), return_inverse=True)
        top = np.full(at.max() + 1, -np.inf)
        np.maximum.at(top, at, eta)
        e = np.exp(eta - top[at])
        norm = np.bincount(at, e)
        p = e / norm[at]
        hit = (pdf["slot"] == pdf["label"]).to_numpy(float)
        out[0] = (hit * (eta - top[at] - np.log(norm)[at])).sum()
        out[1 : 1 + d] = (hit - p) @ x
        mean = np.zeros((top.size, d))
        np.add.at(mean, at, p[:, None] * x)
        out[1 + d :] = ((x * p[:, None]).T @ x - mean.T @ mean).ravel()
        return out

    parts = used.mapInPandas(reduce, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(1 + d + d * d)
    for row in parts.collect():  # (1 + d + d * d) numbers
        out[row["i"]] = row["v"]
    return out


# -- assignment --------------------------------------------------------------------------------


def best_candidate(probs: DataFrame) -> DataFrame:
    """Most probable slot per peak, the first one on ties."""
    best = F.max(F.struct("p", (-F.col("slot")).alias("neg"), "compound_id"))
    return probs.groupBy("peak_id").agg(best.alias("b")).select(
        "peak_id", (-F.col("b.neg")).alias("slot"), F.col("b.compound_id").alias("compound_id"), F.col("b.p").alias("p")
    )


def assign(probs: DataFrame, threshold: float = 0.5, top: int | None = 2) -> DataFrame:
    """(peak_id, compound_id, p, rank): non-null candidates at or above the threshold, at most ``top``."""
    order = Window.partitionBy("peak_id").orderBy(F.desc("p"), "slot")
    ranked = probs.where((F.col("slot") > 0) & (F.col("p") >= threshold)).select(
        "peak_id", "compound_id", "p", F.row_number().over(order).alias("rank")
    )
    return ranked if not top else ranked.where(F.col("rank") <= top)


def evaluation_pairs(probs: DataFrame, assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """(peak_id, compound_id, p, y, yhat) over candidates and true pairs of the evaluated peaks.

    ``truth`` holds (peak_id, true_compound) of the peaks to evaluate; a true compound that is not
    a candidate enters with probability zero.
    """
    peaks = truth.select("peak_id")
    cand = grown_join(probs.where("slot > 0").select("peak_id", "compound_id", "p"), peaks, ["peak_id"], "left_semi")
    true = truth.where("true_compound IS NOT NULL").select("peak_id", F.col("true_compound").alias("compound_id"), F.lit(1).alias("y"))
    hat = assigned.select("peak_id", "compound_id", F.lit(1).alias("yhat"))
    on = ["peak_id", "compound_id"]
    return grown_join(grown_join(cand, true, on, "full"), hat, on, "left").select(
        *on, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("yhat", F.lit(0)).alias("yhat")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """TP, FP, FN over pairs and micro precision, recall and F1."""
    y, h = F.col("y") == 1, F.col("yhat") == 1
    c = pairs.agg(F.count_if(y & h).alias("tp"), F.count_if(h & ~y).alias("fp"), F.count_if(y & ~h).alias("fn"))
    c = c.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return c.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def peak_metrics(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Macro F1 and Jaccard, false-assignment rate on noise, assignment rate, cardinality error.

    Empty prediction and empty truth count as perfect; exactly one empty counts as zero.
    """
    per = pairs.groupBy("peak_id").agg(
        F.sum("yhat").alias("k"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("yhat")).alias("i")
    )
    every = grown_join(truth.select("peak_id"), per, ["peak_id"], "left").select(
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("k", "t", "i")]
    )
    k, t, i = F.col("k"), F.col("t"), F.col("i")
    both_empty = (k == 0) & (t == 0)
    f1 = F.when(both_empty, 1.0).when(k + t > 0, 2.0 * i / (k + t)).otherwise(0.0)
    jac = F.when(both_empty, 1.0).otherwise(i / F.nullif(k + t - i, F.lit(0)))
    assigned = (k > 0).cast("double")
    m = every.agg(
        F.avg(f1).alias("f1_macro"), F.avg(jac).alias("jaccard_macro"),
        F.coalesce(F.avg(F.when(t == 0, assigned)), F.lit(0.0)).alias("far_null"),
        F.avg(assigned).alias("assignment_rate"), F.avg(F.abs(k - t).cast("double")).alias("cardinality_mae"),
    )
    return m.withColumn("tnr_null", F.lit(1.0) - F.col("far_null"))


def compound_metrics(assigned: DataFrame, truth: DataFrame, decoys: DataFrame | None = None) -> DataFrame:
    """Identification of compounds: a predicted decoy is always a false positive."""
    pred = grown_join(assigned, truth.select("peak_id"), ["peak_id"], "left_semi").select("compound_id").distinct().withColumn("_p", F.lit(1))
    true = truth.where("true_compound IS NOT NULL").select(F.col("true_compound").alias("compound_id")).distinct().withColumn("_t", F.lit(1))
    both = grown_join(pred, true, ["compound_id"], "full")
    if decoys is None:
        both = both.withColumn("_d", F.lit(False))
    else:
        flags = decoys.where("is_decoy").select("compound_id", F.lit(True).alias("_d"))
        both = lookup_join(both, flags, ["compound_id"], "left", max_bytes=GROWING_BYTES).withColumn("_d", F.coalesce("_d", F.lit(False)))
    p, t, d = F.col("_p").isNotNull(), F.col("_t").isNotNull(), F.col("_d")
    c = both.agg(
        F.count_if(p & t & ~d).alias("identified"), F.count_if(t).alias("total"),
        F.count_if(p & (d | ~t)).alias("false_positives"), F.count_if(t & ~p).alias("missed"),
        F.count_if(p & d).alias("decoys_assigned"), F.count_if(p).alias("predicted"),
    )
    c = c.withColumns(
        {
            "compound_precision": _ratio(F.col("identified"), F.col("predicted")),
            "compound_recall": _ratio(F.col("identified"), F.col("total")),
        }
    )
    return c.withColumn("compound_f1", _f1(F.col("compound_precision"), F.col("compound_recall")))


def compound_coverage(pairs: DataFrame) -> DataFrame:
    """Share of a true compound's peaks that were assigned to it."""
    return pairs.where("y = 1").groupBy("compound_id").agg(
        F.avg(F.col("yhat").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_peaks")
    )


def evaluate(
    probs: DataFrame, truth: DataFrame, decoys: DataFrame | None = None, threshold: float = 0.5,
    top: int | None = 2, labelled: DataFrame | None = None,
) -> DataFrame:
    """All assignment metrics in one row; peaks that were labelled for training are left out."""
    if labelled is not None:
        truth = grown_join(truth, labelled.select("peak_id"), ["peak_id"], "left_anti")
    chosen = stored(assign(probs, threshold, top))
    pairs = stored(evaluation_pairs(probs, chosen, truth))
    parts = [
        pair_metrics(pairs), peak_metrics(pairs, truth), compound_metrics(chosen, truth, decoys),
        compound_coverage(pairs).agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage")),
        expected_calibration_error(pairs).select("ece"), macro_calibration_error(pairs), brier(pairs),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), ["_k"])
    return out.drop("_k")
