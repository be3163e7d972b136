"""The near-copies stage against all pairs, in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import minhash, simhash


def shingles(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} or {tuple(parts)}


def kept_of(rows):
    """The least id of each component of pairs that share 0.8 of their 5-word shingles."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def test_near_copies_of_five_words(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        # 3 changed words of 200 leave a similarity of about 0.86, 12 leave about 0.55
        texts += [words, edited(rng, words, 3), edited(rng, words, 12), words[:100] + [f"x{rng.randrange(5000)}" for _ in range(100)]]
    crowd = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts += [edited(rng, crowd, 2) for _ in range(90)]  # more than a bucket takes
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "Two words"), (903, "two  WORDS")]
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    want = kept_of(rows)
    assert sorted(r["doc_id"] for r in got.collect()) == want and 60 < len(want) < 110


@pytest.mark.parametrize("bucket", [0, 64])
def test_template_with_close_pairs(spark, monkeypatch, bucket):
    """150 texts of one template, about 0.7 alike, and 20 edited copies among them."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rng = random.Random(5)
    frame = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [edited(rng, frame, 5) for _ in range(150)]
    texts += [edited(rng, t, 2) for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = simhash.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    want = kept_of(rows)
    assert sorted(r["doc_id"] for r in got.collect()) == want and 100 < len(want) <= 150


def test_rare_shingles_miss_no_pair(spark):
    rng = random.Random(9)
    frame = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        words = edited(rng, frame, rng.randrange(6))[: rng.randrange(60, 121)]
        texts += [" ".join(words), " ".join(edited(rng, words, rng.randrange(3))), " ".join(words[: rng.randrange(len(words))])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "one", "two", "", None])], "doc_id bigint, text string")
    sets = minhash.described(docs).dropDuplicates(["sh"]).cache()
    crowd = sets.select("sh", F.col("sh").alias("comp"))
    got = {(r["a"], r["b"]) for r in minhash._sharing(minhash._rare_first(crowd, sets, docs)).collect()}
    own = {r["sh"]: minhash.shingles(r["text"]) for r in sets.join(docs, "doc_id").select("sh", "text").collect()}
    ids = sorted(own)
    every = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    near = {(a, b) for a, b in every if minhash.jaccard(own[a], own[b]) >= minhash.SIMILARITY}
    assert near <= got and 50 < len(near) and len(got) < len(every) / 2
    assert all(np.isin(own[a], own[b]).any() for a, b in got)
