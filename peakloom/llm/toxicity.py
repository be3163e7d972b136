"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each model sees the words of the text and the
probabilities of the categories before it. While learning, those probabilities come from models that
did not see the row (out-of-fold predictions), so later models learn how far they can be trusted.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import annotate, table, word_hashes

#: Order of the chain; columns of the labels, 0 or 1.
CATEGORIES = ("quality", "toxic")
#: Labelled rows the models are fitted on, at most. Prediction covers every row.
SAMPLE = 12_000
DIMENSIONS = 1 << 17
FOLDS = 3
RIDGE = 1e-5
#: Newton steps of a fit and conjugate steps within one, at most, and the largest slope of the
#: penalised loss that counts as none.
ROUNDS = 100
INNER = 400
SETTLED = 1e-5


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, indices, values): hashed words of every text, log-scaled counts of unit length."""
    hashes, bounds = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    cells, counts = np.unique(doc * DIMENSIONS + (hashes & np.uint64(DIMENSIONS - 1)).astype(np.int64), return_counts=True)
    doc, index = np.divmod(cells, DIMENSIONS)
    # presence counts for more than repetition, or a few telling words drown in a long text
    value = 1.0 + np.log(counts)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=len(texts)))
    scale = 1.0 / np.maximum(1.0, np.sqrt(np.maximum(norm, 1.0)))
    return np.searchsorted(doc, np.arange(len(texts) + 1)), index, value * scale[doc]


class Rows:
    """Sparse rows with the products a linear model needs, and dense columns beside them."""

    def __init__(self, bounds, index, value, extra):
        self.n, self.index, self.value, self.extra = len(bounds) - 1, index, value, extra
        self.row = np.repeat(np.arange(self.n), np.diff(bounds))

    def dot(self, w):
        head, tail = w[:DIMENSIONS], w[DIMENSIONS:]
        return np.bincount(self.row, weights=self.value * head[self.index], minlength=self.n) + self.extra @ tail

    def back(self, r):
        return np.concatenate([np.bincount(self.index, weights=self.value * r[self.row], minlength=DIMENSIONS), self.extra.T @ r])

    def take(self, keep):
        new = np.cumsum(keep) - 1
        cell = keep[self.row]
        out = Rows.__new__(Rows)
        out.n, out.row = int(keep.sum()), new[self.row[cell]]
        out.index, out.value, out.extra = self.index[cell], self.value[cell], self.extra[keep]
        return out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def telling(rows: Rows, y: np.ndarray, prior: float = 10.0) -> np.ndarray:
    """How many standard errors the log odds of each hashed word are from none, less one; 0 for
    words that tell nothing. ``prior`` is the weight of the overall rate."""
    n, n_pos = len(y), y.sum()
    count = np.bincount(rows.index, minlength=DIMENSIONS).astype(float)
    pos = np.bincount(rows.index, weights=y[rows.row], minlength=DIMENSIONS)
    a, b = pos + prior * count / n, count - pos + prior * count / n
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / (n_pos + prior)) - np.log(b / (n - n_pos + prior))
        z = np.abs(odds) / np.sqrt(1 / a + 1 / b)
    return np.maximum(np.where(count > 0, z, 0.0) - 1.0, 0.0)


def conjugate(curve, near, grad, goal: float) -> np.ndarray:
    """Solve ``curve(d) = -grad`` by preconditioned conjugate steps until the rest is below ``goal``."""
    d, rest = np.zeros_like(grad), -grad
    way = lean = rest / near
    size = rest @ lean
    for _ in range(INNER):
        bent = curve(way)
        step = size / (way @ bent)
        d, rest = d + step * way, rest - step * bent
        if np.linalg.norm(rest) <= goal:
            break
        lean = rest / near
        size, before = rest @ lean, size
        way = lean + size / before * way
    return d


def fit(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps, each solved by conjugate steps; the last
    weight is the intercept. Words are scaled by what they tell, and both classes weigh the same.
    Without two classes only the intercept is set. A fit that has not settled says so in a warning."""
    out = np.zeros(DIMENSIONS + rows.extra.shape[1])
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        out[-1] = np.log(share / (1 - share)) if len(y) else -35.0
        return out
    told = telling(rows, y)
    used = told > 0  # the weights of all other words are 0 at the optimum
    place, cell = np.cumsum(used) - 1, used[rows.index]
    row, index, value = rows.row[cell], place[rows.index[cell]], (rows.value * told[rows.index])[cell]
    n_used, extra = int(used.sum()), rows.extra
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = np.full(n_used + extra.shape[1], RIDGE)
    penalty[-1] = 0.0

    def dot(w):
        return np.bincount(row, weights=value * w[index], minlength=rows.n) + extra @ w[n_used:]

    def back(r, value=value, extra=extra):
        return np.concatenate([np.bincount(index, weights=value * r[row], minlength=n_used), extra.T @ r])

    def loss(w, z):
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum()

    w = np.zeros(len(penalty))
    z = dot(w)
    for _ in range(ROUNDS):
        p = sigmoid(z)
        grad = back(weight * (p - y)) + penalty * w
        if np.abs(grad).max() <= SETTLED:
            break
        bend = weight * p * (1 - p)
        near = back(bend, value**2, extra**2) + penalty + 1e-12
        norm = np.linalg.norm(grad)
        d = conjugate(lambda v: back(bend * dot(v)) + (penalty + 1e-12) * v, near, grad, norm * min(0.5, np.sqrt(norm)))
        dz, now, slope, size = dot(d), loss(w, z), grad @ d, 1.0
        while loss(w + size * d, z + size * dz) > now + 1e-4 * size * slope and size > 1e-8:
            size /= 2
        w, z = w + size * d, z + size * dz
    else:
        warnings.warn(f"fit stopped after {ROUNDS} steps at a slope of {np.abs(grad).max():.1e}", stacklevel=2)
    out[:DIMENSIONS][used] = told[used] * w[:n_used]
    out[DIMENSIONS:] = w[n_used:]
    return out


def fit_chain(bounds, index, value, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category, in order; ``labels`` [row, category], not a number where
    unknown. Each category learns from the rows that have its label."""
    n = len(bounds) - 1
    extra = np.ones((n, 1))
    chain = []
    for j in range(labels.shape[1]):
        rows, y = Rows(bounds, index, value, extra), labels[:, j].astype(float)
        known = ~np.isnan(y)
        chain.append(fit(rows.take(known), y[known]))
        if j + 1 < labels.shape[1]:
            apart = np.zeros(n)
            for f in range(FOLDS):
                test = fold == f
                learned = known & ~test
                apart[test] = sigmoid(rows.take(test).dot(fit(rows.take(learned), y[learned])))
            extra = np.column_stack([extra[:, :-1], apart, np.ones(n)])
    return chain


def predict_chain(texts, chain: list[np.ndarray]) -> np.ndarray:
    """Probabilities [text, category]; each category sees those before it."""
    bounds, index, value = features(texts)
    extra = np.ones((len(texts), 1))
    out = []
    for w in chain:
        out.append(sigmoid(Rows(bounds, index, value, extra).dot(w)))
        extra = np.column_stack([extra[:, :-1], out[-1], np.ones(len(texts))])
    return np.column_stack(out) if out else np.zeros((len(texts), 0))


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> list[np.ndarray]:
    """Fit the chain on at most ``sample`` labelled documents, chosen by a hash of the id.

    A row counts for the categories in which it has a label. Of repeated ids the largest labels and
    the text with the least hash count, and documents without text are not learned from. Without
    labels every probability is near 0.
    """
    some = " OR ".join(f"`{c}` IS NOT NULL" for c in categories)
    known = labels.where(f"doc_id IS NOT NULL AND ({some})")
    known = known.groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"y{j}") for j, c in enumerate(categories)])
    total = known.count()
    ticket = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30))
    share = min(1.0, 0.95 * sample / max(total, 1))
    picked = known.where(ticket < F.lit(int(share * (1 << 30)))).limit(sample)  # at most ``sample`` narrow rows
    names = [f"y{j}" for j in range(len(categories))]
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(texts):
        bounds, index, value = features(texts)
        cut = list(zip(bounds, bounds[1:]))
        return {"index": [index[a:b].astype("<i4").tobytes() for a, b in cut], "value": [value[a:b].astype("<f4").tobytes() for a, b in cut]}

    got = annotate(rows, [("index", "binary"), ("value", "binary")], run, keep=["doc_id", *names]).toPandas().sort_values("doc_id")
    sizes = [len(x) // 4 for x in got["index"]]
    flat = lambda c, packed, kind: np.frombuffer(b"".join(got[c]), dtype=packed).astype(kind)
    fold = (got["doc_id"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FOLDS)
    return fit_chain(np.cumsum([0, *sizes]), flat("index", "<i4", np.int64), flat("value", "<f4", float), got[names].to_numpy(dtype=float), fold.astype(int))


def classify(docs: DataFrame, chain: list[np.ndarray], categories=CATEGORIES, keep=None) -> DataFrame:
    """The kept columns (all by default) plus ``p_<category>`` for each category.

    Null and empty texts have no words and get what the intercepts say. Columns of the new names are
    replaced; rows are judged one by one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in chain])  # DIMENSIONS numbers per category

    def run(texts):
        p = predict_chain(texts, shipped.value)
        return {f"p_{c}": p[:, j].tolist() for j, c in enumerate(categories)}

    return annotate(docs, [(f"p_{c}", "double") for c in categories], run, keep=keep)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.withColumn("toxic", F.col("p_toxic") > 0.5)
