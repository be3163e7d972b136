"""Benchmark items shorter than the window, with every substitution that is allowed."""

import itertools
import math

import pytest

from peakloom.llm import decontamination


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_short_items_with_every_allowed_substitution(spark, broadcast):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(5, 13)]
    rows, want = [], []
    for n, text in items:
        most = n - math.ceil(0.8 * n)
        for k in range(most + 2):
            for gone in itertools.combinations(range(n), k):
                rows.append((len(rows), "in front " + " ".join("zzz" if j in gone else w for j, w in enumerate(text.split())) + " behind"))
                want.append({n} if k <= most else set())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_words=broadcast)
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in found.select("doc_id", "leaks").collect()}
    assert [got[i] for i in range(len(rows))] == want
