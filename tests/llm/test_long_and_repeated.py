"""Very long texts, many equal rows, and labels that are known in part."""

import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import privacy, suffixes, toxicity
from tests.llm import brute


def test_many_numbers_in_one_text(spark):
    text = " ".join(f"1.2.{i % 256}.{i % 199}" if i % 5 else f"x{i}@mail.example" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.time()
    out = privacy.find_private(docs).select(F.col("base"), F.concat("base", "added").alias("s"), privacy.sanitised(F.col("text"), F.concat("base", "added")).alias("t")).first()
    assert time.time() - start < 60
    assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in out["base"]] == brute.base_spans(text)
    at, want = 0, []
    for s in sorted(out["s"]):
        if s["start"] >= at:
            want += [text[at : s["start"]], "" if s["kind"] == "removed" else f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    assert out["t"] == "".join([*want, text[at:]])


def test_spans_over_chunks(spark):
    # entities longer than a chunk, at and across its edges, and characters beyond 16 bits
    rows = []
    for lead in (0, 1, privacy.CHUNK - 3, privacy.CHUNK, privacy.WIDE - 2):
        rows.append((len(rows), "😀 " * (lead // 2) + "é" * (lead % 2) + " " + "a" * 3000 + "@mail.example and 10.0.0.1 " + "b" * 1500))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = privacy.base_spans(F.col("text"))
    for (i, text), r in zip(rows, docs.select("doc_id", spans.alias("s"), privacy.sanitised(F.col("text"), spans).alias("t")).orderBy("doc_id").collect()):
        own = brute.base_spans(text)
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["s"]] == own and len(own) == 2
        assert r["t"] == brute.sanitise(text, own, [])


def test_equal_rows_are_cut_once(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    shared = word(120)
    rows = [(1, f"{word(30)} {shared} {word(30)}")] * 5_000 + [(2, f"{word(20)} {shared}"), (3, word(200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    start = time.time()
    got = {r["doc_id"]: (r["n"], r["left"]) for r in suffixes.remove_repeats(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("kept")).alias("left")).collect()}
    assert time.time() - start < 120
    # every byte of a repeated row starts elsewhere too; the second text keeps what is its own
    assert got[1] == (5_000, 0) and got[3] == (1, len(rows[-1][1]))
    assert got[2] == (1, len(rows[-2][1]) - len(shared) - 1)


def labelled_rows(n=240):
    rng = np.random.default_rng(5)
    texts, labels = [], np.zeros((n, 2))
    for i in range(n):
        labels[i] = (i % 2, (i // 2) % 3 == 0)
        words = [f"w{rng.integers(0, 60)}" for _ in range(12)] + ["good"] * int(labels[i, 0]) * 2 + ["vile"] * int(labels[i, 1])
        texts.append(" ".join(words))
    return texts, labels


def test_every_link_is_at_its_optimum():
    texts, y = labelled_rows()
    rows = toxicity.Rows(*toxicity.features(texts), np.ones((len(texts), 1)))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        w = toxicity.fit(rows, y[:, 0])
    # the penalised loss worked out again, text by text
    scale = np.concatenate([toxicity.telling(rows, y[:, 0]), [1.0]])
    own = np.divide(w, scale, out=np.zeros_like(w), where=scale > 0)
    slope = toxicity.RIDGE * own
    slope[-1] = 0
    for i, text in enumerate(texts):
        _, index, value = toxicity.features([text])
        z = value @ w[index] + w[-1]
        share = 0.5 / (y[:, 0] == y[i, 0]).sum()
        slope[index] += share * (1 / (1 + np.exp(-z)) - y[i, 0]) * value * scale[index]
        slope[-1] += share * (1 / (1 + np.exp(-z)) - y[i, 0])
    assert np.abs(slope).max() < 2 * toxicity.SETTLED


@pytest.mark.parametrize("hidden", [0, 40])
def test_later_links_see_predictions_of_other_folds(monkeypatch, hidden):
    texts, y = labelled_rows()
    y[:hidden, 0] = np.nan
    fold = np.arange(len(texts)) % toxicity.FOLDS
    fitted, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: fitted.append((rows, y)) or fit(rows, y))
    toxicity.fit_chain(*toxicity.features(texts), y, fold)
    rows, last = fitted[-1]
    # a missing first label does not cost the row its second one
    assert len(fitted) == 2 + toxicity.FOLDS and len(last) == len(texts)
    for f in range(toxicity.FOLDS):
        learned = [i for i in range(len(texts)) if fold[i] != f and not np.isnan(y[i, 0])]
        w = fit(toxicity.Rows(*toxicity.features([texts[i] for i in learned]), np.ones((len(learned), 1))), y[learned, 0])
        for i in np.flatnonzero(fold == f):
            _, index, value = toxicity.features([texts[i]])
            assert rows.extra[i, 0] == pytest.approx(1 / (1 + np.exp(-(value @ w[index] + w[-1]))), abs=1e-6)


def test_labels_known_in_part(spark):
    texts, y = labelled_rows(60)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "another text of the same id")] * 3, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, None if i % 3 else int(q), int(t)) for i, (q, t) in enumerate(y)], "doc_id bigint, quality int, toxic int")
    out = toxicity.classify(docs, toxicity.learn(docs, labels))
    rows = {r["text"]: r["p_toxic"] > 0.5 for r in out.collect()}
    assert np.mean([rows[t] == bool(v) for t, v in zip(texts, y[:, 1])]) > 0.95
