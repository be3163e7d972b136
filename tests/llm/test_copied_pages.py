"""Copies of a page and the terms that disclose an entity."""

import random

from peakloom.llm import privacy


def test_copies_do_not_hide_disclosing_terms(spark):
    rng = random.Random(3)
    filler = [" ".join(rng.choice(["the", "and", "with", "from", "page"]) + f" {rng.randrange(10**6)}" for _ in range(8)) for _ in range(2_000)]
    pages = ["Zorblatt of Quimby writes to zorb@mail.example today", "Ask Zorblatt in Quimby or zorb@mail.example instead"]

    def added(copies):
        texts = filler + [p for p in pages for _ in range(copies)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        rows = privacy.find_private(docs).where("size(added) > 0").select("text", "added").distinct().collect()
        return {r["text"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in rows}

    one = added(1)
    assert len(one) == 2 and all({"Zorblatt", "Quimby"} <= {t[s:e] for s, e, _ in spans} for t, spans in one.items())
    assert added(1_000) == one
