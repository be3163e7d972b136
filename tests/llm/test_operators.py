"""Each operator against its plain version, and on rows that are null, empty, long or repeated."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from peakloom.llm import bpe, common, decontamination, language, privacy, simhash, spans, suffixes, token_counts, topk, toxicity
from tests.llm import brute
from tests.llm.conftest import PROSE, ROWS, SF_DIR

TEXTS = [r[1] for r in ROWS]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- helpers ----------------------------------------------------------------------------------


def test_word_hashes_are_words():
    texts = ["Hello wörld hello", None, "", "x-1 HELLO"]
    h, b = common.word_hashes(texts)
    assert b.tolist() == [0, 3, 3, 3, 6]
    assert h[0] == h[2] == h[5] and len({*h.tolist()}) == 4
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é.\n9_") for _ in range(rng.randrange(60))) for _ in range(50)]
    h, b = common.word_hashes(texts)
    name = {}
    for t, s, e in zip(texts, b, b[1:]):
        own = brute.words(t)
        assert len(own) == e - s
        for w, x in zip(own, h[s:e].tolist()):
            assert name.setdefault(w, x) == x
    assert len(set(name.values())) == len(name)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 ----------------------------------------------------------------------------------------


def leak_rows(df):
    return sorted(((r["doc_id"], sorted(map(tuple, r["leaks"]), key=repr)) for r in df.select("doc_id", "leaks").collect()), key=repr)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, odd, broadcast):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 25, 14, 13, 9, 8, 7, 6, 5, 4, 1, 0])] + [(50, None), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    items.append((60, items[0][1]))  # the same item twice
    rows = []
    for i, (_, text) in enumerate(items[:8]):
        w = (text or "").split()
        swapped = ["zzz" if j % 6 == 3 else x for j, x in enumerate(w)]
        broken = ["zzz" if j % 3 == 1 else x for j, x in enumerate(w)]
        for j, v in enumerate((w, swapped, broken, [x.upper() + "," for x in w])):
            rows.append((100 + 10 * i + j, "front matter " + " ".join(v) + " back matter"))
    rows += [(300, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (301, None), (302, ""), (None, items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("leaks", F.lit(1))
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), broadcast_words=broadcast)
    assert found.columns == ["doc_id", "text", "leaks"]
    want = sorted(((d, sorted(brute.leaks(t, items, decontamination.MASKS, 13, 0.8), key=repr)) for d, t in rows), key=repr)
    assert leak_rows(found) == want
    whole = lambda d: {x[0] for x in dict(leak_rows(found))[d]}
    assert whole(101) >= {0, 60} and not whole(102) & {0, 60}


def test_decontamination_edges(spark, odd, none, clashing):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id int, text string")
    assert decontamination.find_leaks(none, items).count() == 0
    assert decontamination.find_leaks(odd, items.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontamination.find_leaks(clashing, items).count() == len(ROWS)


# -- 2 ----------------------------------------------------------------------------------------


def test_language_against_plain_parsing(spark, real):
    training = language.learn(real)
    assert set(training) == {"de", "en", "es", "fr"} and all(0 < len(t) <= language.CHARS_PER_LANGUAGE for t in training.values())
    short = {k: v[:3_000] for k, v in training.items()}
    alphabet = brute.alphabet_of(short, language.ALPHABET)
    docs = real.where(F.length("text") < 6_000)
    got = {r["doc_id"]: r for r in language.identify(docs, short).collect()}
    for r in docs.collect():
        name, score = brute.language(r["text"], short, alphabet, language.BLOCK)
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == (name, pytest.approx(score))


def test_language_on_held_out_rows(spark):
    out = language.op2(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, odd, none, clashing):
    training = {"en": language.fold(PROSE * 2), "de": language.fold("der die das und nicht ein eine Größe Straße über schön " * 4)}
    got = language.identify(odd, training).collect()
    assert len(got) == len(ROWS)
    by_text = {r["text"]: r for r in got}
    assert [(by_text[t]["lang_pred"], by_text[t]["score"]) for t in (None, "", " \n\t ", "12345 !!! 67.8")] == [("und", 0.0)] * 4
    assert by_text[PROSE * 400]["lang_pred"] == "en" and by_text[TEXTS[11]]["lang_pred"] == "de"
    assert language.identify(none, training).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.learn(none) == {} and language.learn(odd.withColumn("lang", F.lit(None).cast("string"))) == {}
    columns = clashing.columns
    kept = language.stage(spark, clashing, SF_DIR)
    assert kept.columns == columns and kept.count() == len(ROWS) - 4
    one = language.identify(odd, {"en": "abc"}).where("text = 'two words'").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)


# -- 3 ----------------------------------------------------------------------------------------


def removed(df):
    size = lambda s: s["end"] - s["start"]
    out = df.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + size(s)), F.size("spans"), F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"queue_tuples": 40, "column_bytes": 3_000}, {"crowded": 1}])
def test_suffixes(spark, real, odd, settings):
    docs = real.where("doc_id < 90").select("doc_id", "text").unionAll(odd.where(F.coalesce(F.length("text"), F.lit(0)) < 31_000).select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = removed(suffixes.remove_repeats(docs, 40, gram=20, **settings))
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute.repeated([t for _, t in rows], 40))), key=repr)
    assert got == want and sum(w[2] for w in want) > 1_000


def test_suffix_query(spark, real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    got = sorted(map(tuple, suffixes.op3(spark, SF_DIR).collect()))
    assert got == sorted((d, *x) for (d, _), x in zip(rows, brute.repeated([t for _, t in rows], 200)))


def test_suffix_edges(spark, none, clashing):
    assert suffixes.remove_repeats(none).count() == 0
    out = suffixes.remove_repeats(clashing, 50, gram=25)
    assert out.count() == len(ROWS)
    assert [c for c in clashing.columns if c not in ("n_bytes", "spans", "kept")] == [c for c in out.columns if c not in ("n_bytes", "spans", "kept")]


def test_anchor_depends_on_the_window_alone():
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 12, 400).astype(np.uint64) << np.uint64(40)
    where = suffixes.anchors(grams, 13)
    assert where.tolist() == [i + int(np.argmin(grams[i : i + 13])) for i in range(len(grams) - 12)]


def test_queue_orders_and_carries_prefixes(tmp_path):
    """One step of induction from sorted suffixes gives the sorted longer suffixes and their prefixes."""
    rng = random.Random(2)
    tails = sorted("".join(rng.choice("ab") for _ in range(6)) for _ in range(200))
    heads = [rng.choice("xyz") for _ in tails]
    common_ = [0] + [next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), 6) for a, b in zip(tails, tails[1:])]
    for most in (7, 10**6):
        queue = suffixes.ByteQueue(str(tmp_path), 200, most)
        for at in range(0, 200, 30):
            part = slice(at, at + 30)
            ids = np.arange(200)[part]
            queue.push(ids, np.array(common_[part], np.int16), np.array([ord(h) for h in heads[part]], np.uint8), ids % 5 != 0)
        ids, value = (np.concatenate(x) for x in zip(*queue.drain(11)))
        full = [heads[i] + tails[i] for i in ids]
        assert full == sorted(heads[i] + tails[i] for i in range(200) if i % 5)
        want = [0] + [next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), 7) for a, b in zip(full, full[1:])]
        assert value.tolist() == want


# -- 4 ----------------------------------------------------------------------------------------


def word_path():
    import public_tokenizers

    return public_tokenizers.path(token_counts.VOCABULARY)


def test_token_counts_equal_the_library(spark, real, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_path())
    more = [(900 + i, t) for i, t in enumerate([
        "<|endoftext|> hi<|startoftext|>X<|endoftext|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ß ﬁ", "it's we'll I'D 1234 ½ ²", "áë ẛ̣", "x\x1cy\x85z\xa0q", "don't'sre'veS", "ab" * 5_000, "ſ K Å <|endoftext|", "﻿x​y",
    ])]
    docs = real.select("doc_id", "text").unionAll(odd.select("doc_id", "text")).unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = token_counts.count_tokens(docs, word_path()).collect()
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids), text[:50]
        assert r["n_bytes"] == len(text.encode())


def test_merging_follows_ranks():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("a", "a"): 3}
    assert token_counts.merged_length(list("abc"), ranks) == 1
    assert token_counts.merged_length(list("aaaaa"), ranks) == 3
    assert token_counts.merged_length(["a"], ranks) == 1

    def plain(s):
        while True:
            options = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
            if not options:
                return len(s)
            _, i = min(options)
            s = [*s[:i], s[i] + s[i + 1], *s[i + 2 :]]

    rng = random.Random(9)
    for _ in range(300):
        word = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
        assert token_counts.merged_length(word, ranks) == plain(word)


def test_token_count_edges(spark, none, clashing):
    assert token_counts.count_tokens(none, word_path()).count() == 0
    assert sorted(token_counts.count_tokens(clashing, word_path()).columns) == sorted(clashing.columns)
    with pytest.raises(ValueError):
        token_counts.Counter(json.dumps(json.loads(open(word_path(), "rb").read()) | {"normalizer": {"normalizers": []}}).encode())


# -- 5 ----------------------------------------------------------------------------------------


def test_sentence_spans(spark):
    a, b, c, d = ("Alpha beta gamma delta one.", " Second line has words too!", "\nThird sentence follows the others?", " Fourth one closes it.")
    rows = [(3, "Start here now." + " " + a + b + c + d), (1, a + b + c), (2, "Own words. " + a + b), (4, None), (5, ""), (6, "Tiny. Tiny. Tiny. Tiny. Tiny."), (7, a + b + c + a + b + c), (None, a + b + c)]
    out = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), span=2).collect()}
    assert out[3]["kept"] == "Start here now." + d and out[3]["n_removed"] == 3
    assert out[2]["kept"] == "Own words."
    assert out[1]["kept"] == "" and out[None]["kept"] == a + b + c  # a null id comes first
    assert out[4]["kept"] is None and out[5]["kept"] == ""
    assert out[6]["n_removed"] == 4  # the runs behind the first one
    assert out[7]["n_removed"] == 6


def test_short_sentences_count(spark):
    lines = "".join(f"Line {i}.\n" for i in range(40))
    rows = [(1, lines), (2, lines), (None, PROSE * 2 + "One end."), (None, PROSE * 2 + "Other end.")]
    out = spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), span=2).collect()
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in out}
    assert got[1, lines] == 0 and got[2, lines] == 40
    # texts without an id are documents of their own
    assert sorted(n for (d, _), n in got.items() if d is None) == [0, 2]


def test_sentence_span_edges(spark, odd, none, clashing):
    assert spans.remove_repeats(none).count() == 0
    out = spans.remove_repeats(clashing)
    assert out.count() == len(ROWS)
    again = [r for r in spans.remove_repeats(odd).collect() if r["text"] == PROSE * 3]
    assert len(again) == 2 and again[0] == again[1]


# -- 6 ----------------------------------------------------------------------------------------

PRIVATE = [
    "Mail a@b.c_d@e.f or x.y+z@mail.example.org, a@b@c.d, a@b., @c.d end",
    "IPs 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 00255.001.2.3 1.2.3 99999999999999999999.1.1.1 1.1.1.1.",
    "Cards 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 5500 0000 0000 0004 0000000000000 1 2 3",
    "Phones +1 (555) 123-4567, +49.30.1234567, +1 2, ++441234567890 +1-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 +12345678",
    "8" * 30_000, "a" * 30_000 + "@x.y", "1.2." * 5_000, "+1" + " " * 20_000 + "2", "é👩‍👧 mail ü@x.de +49 30 123456789 ß", None, "",
]


def test_base_spans(spark, real):
    rows = [(i, t) for i, t in enumerate(PRIVATE)] + [(1000 + r["doc_id"], r["text"]) for r in real.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = df.select("doc_id", privacy.base_spans(F.col("text")).alias("s")).collect()
    texts = dict(rows)
    for r in got:
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["s"]] == brute.base_spans(texts[r["doc_id"]]), r["doc_id"]


def test_disclosing_terms(spark, real):
    rng = random.Random(8)
    common_ = ["the", "and", "with", "from", "page"]
    extra = []
    for i in range(60):
        filler = " ".join(rng.choice(common_) for _ in range(12))
        who = rng.choice([("Zorblatt", "zorb@mail.example"), ("Quimby", "+1 555 123 4567")])
        extra.append((5000 + i, f"{filler} {who[0]} writes {who[1]} {filler}" if i % 3 else filler))
    extra.append((5100, extra[1][1]))  # a copy counts once
    docs = real.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id bigint, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = {d: t for (d, _), t in zip(rows, brute.term_spans([t for _, t in rows], privacy.REACH, privacy.ALPHA, privacy.SUPPORT))}
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in privacy.find_private(docs).collect()}
    assert got == want
    named = [t for d, t in rows if d >= 5000 and "Zorblatt" in t]
    assert named and all(any(t[s:e] == "Zorblatt" for s, e, _ in want[d]) for d, t in rows if t in named)


def test_sanitised_text(spark, odd, none, clashing):
    rows = [(1, "Ask jo@x.org now, or +1 555 123 4567."), (2, "nothing here"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in privacy.stage(spark, df, "").collect()}
    assert out == {1: "Ask <EMAIL> now, or <PHONE>.", 2: "nothing here", 3: None}
    assert privacy.stage(spark, none, "").count() == 0
    kept = privacy.stage(spark, clashing, "")
    assert kept.columns == clashing.columns and kept.count() == len(ROWS)
    assert sorted(map(str, kept.collect())) == sorted(map(str, clashing.collect()))


# -- 7 ----------------------------------------------------------------------------------------


def best(rows, k, every):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v in fine]
    out = []
    for q, a in whole:
        if q % every == 0:
            top = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(top)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(256, 4096, 2048), (3, 2, 5)])
def test_top_k(spark, shape):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(150)]
    rows += [(200 + i, rows[20][1]) for i in range(30)]  # many ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0, float("nan"), 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (304, [2.0]), (305, []), rows[5], (40, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("n", F.lit("x"))
    bins, query_block, row_block = shape
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 6, bins, query_block, row_block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(rows, 6, 20)


def test_top_k_edges(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], kind), F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(20, [1.0]), (21, [-2.0])], kind)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, -64 * 128)]


def test_blocks_are_narrow_and_never_broadcast(spark):
    """Files of blocks are far smaller than their rows, which the salts repeat besides."""
    df = spark.createDataFrame([(i, [float(i % 3), -1.5]) for i in range(40)] + [(99, [2.0**40, 1.0])], "vec_id bigint, embedding array<float>")
    blocks = topk.pack(df.where("vec_id < 40").coalesce(1), 8)
    assert {(r["kind"], len(r["vectors"])) for r in blocks.where("n = 8").collect()} == {("<i2", 8 * 2 * 2)}
    assert [r["kind"] for r in topk.pack(df.where("vec_id = 99"), 8).collect()] == ["<f8"]
    queries = blocks.select(F.lit(1).alias("q"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    plan = topk._paired(topk.stored(blocks), topk.stored(queries), 5, 1, [])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scores_are_exact_beyond_doubles():
    a = np.array([[2.0**40, 1.0], [2.0**20, 3.0]])
    assert topk.scores(a, a).tolist() == [[np.iinfo(np.int64).max, 2**60 + 3], [2**60 + 3, 2**40 + 9]]


# -- 8 ----------------------------------------------------------------------------------------


def test_toxicity_on_rows_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    chain = toxicity.learn(docs, labels.where(~test))
    rows = toxicity.classify(docs.select("doc_id", "text"), chain).join(labels.where(test), "doc_id").collect()
    bad, good = ([r["p_toxic"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert len(bad) >= 50 and np.mean(np.array(bad) > 0.5) >= 0.8 and np.mean(np.array(good) < 0.5) >= 0.98


def test_chain_feeds_probabilities_on():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["red", "blue", "tree", "sun", "oak"], 8)) + (" bad" if i % 2 else "") for i in range(200)]
    b, i, v = toxicity.features(texts)
    first = np.arange(200) % 2
    labels = np.column_stack([first, first])
    chain = toxicity.fit_chain(b, i, v, labels, np.arange(200) // 3 % 3)
    assert [len(w) for w in chain] == [toxicity.DIMENSIONS + 1, toxicity.DIMENSIONS + 2]
    assert chain[1][toxicity.DIMENSIONS] > 0.1  # the earlier probability is used
    assert ((toxicity.predict_chain(texts, chain) > 0.5) == labels).all()


def test_toxicity_edges(spark, odd, none, clashing):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    chain = toxicity.learn(odd, empty)
    out = toxicity.classify(clashing, chain).collect()
    assert len(out) == len(ROWS) and all(r["p_toxic"] < 1e-6 for r in out)
    one = spark.createDataFrame([(1, 1, 1), (2, 1, None), (3, 1, 1), (None, 1, 1), (1, 1, 0)], empty.schema)
    out = toxicity.classify(odd, toxicity.learn(odd, one)).collect()
    assert all(0 <= r["p_toxic"] <= 1 for r in out)
    assert toxicity.classify(none, chain).count() == 0


# -- 9 ----------------------------------------------------------------------------------------


def test_simhash_query(spark, real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    values = [brute.fingerprint(t) for _, t in rows]
    groups = brute.linked(values, 2)
    least = {}
    for (d, _), g in zip(rows, groups):
        least[g] = min(d, least.get(g, d))
    want = sorted((d, f"{v:016x}", least[g]) for (d, _), v, g in zip(rows, values, groups))
    assert sorted(map(tuple, simhash.op9(spark, SF_DIR).collect())) == want


@pytest.mark.parametrize("far, bucket", [(2, 64), (2, 1), (1, 64), (1, 1), (0, 64)])
def test_links_give_all_components(spark, far, bucket):
    rng = random.Random(far * 10 + bucket)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(4):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            values.add(v)
    values |= {(0xFFFF << 48) | (1 << b) for b in range(40)}  # a crowded bucket
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), far, bucket).collect()
    assert all(((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= far for e in edges)
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e["a"])] = root(e["b"])
    want = brute.linked(values, far)
    assert len({(root(s), w) for s, w in zip(signed, want)}) == len(set(want)) == len({root(s) for s in signed})


def test_threshold_allocation_is_the_cheapest():
    rng = random.Random(6)
    for m in (1, 2, 3, 4):
        costs = [[0.0] + sorted(rng.random() for _ in range(3)) for _ in range(m)]
        got = simhash.allocate(costs, 2)
        options = [c for c in itertools.product(range(-1, 3), repeat=m) if sum(c) == 2 - m + 1]
        assert sum(got) == 3 - m
        assert sum(c[t + 1] for c, t in zip(costs, got)) == pytest.approx(min(sum(c[t + 1] for c, t in zip(costs, o)) for o in options))


def test_simhash_edges(spark, odd, none, clashing):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ROWS)
    zero = [r for r in found if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} >= {3, 4, 5} and {r["component_id"] for r in zero} == {3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.stage(spark, clashing, "").collect()
    assert len(kept) == len({r["root"] for r in found})
    assert simhash.stage(spark, none, "").count() == 0


# -- 10 ---------------------------------------------------------------------------------------


def ranks():
    return bpe.read_ranks(open(bpe.vocabulary()[0], "rb").read())


def test_byte_bpe_equals_tiktoken(spark, real, odd):
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(), special_tokens={})
    docs = real.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    out = bpe.encode(docs, path, pattern, offsets=True)
    for r in bpe.decode(out, path, pattern).collect():
        text = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert r["decoded_bytes"] == text.encode() and r["decoded"] == text
        assert len(r["starts"]) == len(r["ids"]) and all(0 <= s < e <= len(text) for s, e in zip(r["starts"], r["ends"]))
        if text:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
    got = {(r["doc_id"], r["ids_sha256"]) for r in bpe.op10(spark, SF_DIR).collect()}
    assert got == {(r["doc_id"], sha(np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes())) for r in real.collect()}


def test_split_characters(spark):
    path, pattern = bpe.vocabulary()
    own = spark.createDataFrame([(1, "👩‍👧")], "doc_id bigint, text string")
    row = bpe.encode(own, path, pattern).first()
    cut = spark.createDataFrame([(row["ids"][:1],), (row["ids"],), ([],), (None,)], "ids array<int>")
    out = [(r["decoded"], r["decoded_bytes"]) for r in bpe.decode(cut, path, pattern).collect()]
    assert "�" in out[0][0] and "👩‍👧".encode().startswith(bytes(out[0][1]))
    assert out[1] == ("👩‍👧", "👩‍👧".encode()) and out[2] == ("", b"") and out[3] == (None, None)


def test_bpe_edges(spark, none, clashing):
    path, pattern = bpe.vocabulary()
    assert bpe.encode(none, path, pattern).count() == 0
    out = bpe.stage(spark, clashing, "").collect()
    assert len(out) == len(ROWS) and {(r["doc_id"], r["text"]) for r in out} == {(r[0], r[1] or "") for r in ROWS}
    assert bpe.byte_table()[0x20] == "Ġ" and len(set(bpe.byte_table().values())) == 256
    with pytest.raises(ValueError):
        bpe.last_merge(b"xyz", {b"x": 0, b"y": 1, b"z": 2, b"xyz": 3})
    assert regex.compile(pattern).findall("a b") == ["a", " b"]
