"""The registered queries against DuckDB, and the pipeline against plain Python on the smallest table."""

import hashlib

import duckdb
import numpy as np
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from peakloom.llm import bpe, decontamination, privacy, queries
from tests.llm import brute
from tests.llm.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_against_plain_python(spark, real):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r.asDict() for r in real.collect()]
    rows = [r for r in rows if any(map(str.isalpha, r["text"] or ""))]
    first = {}
    for r, g in zip(rows, brute.near_copies([r["text"] for r in rows])):
        if g not in first or r["doc_id"] < first[g]["doc_id"]:
            first[g] = r
    rows = [r for r in first.values()]
    leaks = lambda text: brute.leaks(text, items, decontamination.MASKS, decontamination.WINDOW, decontamination.SIMILARITY)
    clean = [r for r in rows if not any(end - start >= 5 for _, start, end, _ in leaks(r["text"]))]
    added = brute.term_spans([r["text"] for r in clean], privacy.REACH, privacy.ALPHA, privacy.SUPPORT)
    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    want = []
    for r, more in zip(clean, added):
        text = brute.sanitise(r["text"], brute.base_spans(r["text"]), more)
        ids = library.encode_ordinary(text)
        chars = len(text) if text != r["text"] else r["n_chars"]
        want.append((r["doc_id"], text, r["lang"], r["source"], chars, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "packed_ids", "ids_sha256"]
    assert sorted(map(tuple, got.drop("packed_ids").collect())) == sorted(want)


def test_stages_keep_the_columns(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0
