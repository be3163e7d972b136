"""Weak rules, conversation trie and fill-in-the-middle against their plain versions and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.llm import conversation_trie, fill_middle, weak_rules
from tests.llm import brute
from tests.llm.conftest import ROWS, SF_DIR

# -- 11 ---------------------------------------------------------------------------------------

NAMES = [r[0] for r in weak_rules.RULES]
TEXTS = [
    "a b c a b c", "a b c d a b c", "x x x x", "x x x", "a b a b a", "one\ntwo\none\n \n\none\r\n", "#*$ %&| <> é👩‍👧 日本", "tab\tvt\x0bff\x0ccr\rnbsp\xa0end", None, "", " \n",
]


def test_counts(spark, real, odd):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionAll(real.select("doc_id", "text")).unionAll(odd.select("doc_id", "text"))
    for r in weak_rules.with_counts(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.rule_counts(r["text"]), r["text"]


def test_accuracies(spark, real):
    votes = weak_rules.with_counts(real).select(weak_rules.votes_of().alias("votes"))
    rows = [r["votes"] for r in votes.collect()]
    model = weak_rules.fit(votes, NAMES)
    assert model.converged
    good, right, q = brute.trusted(rows, weak_rules.START_GOOD, weak_rules.START_RIGHT, weak_rules.PSEUDO, model.rounds)
    assert model.good == pytest.approx(good, abs=1e-6)
    assert len(rows) == real.count()
    assert [x for n in NAMES for x in model.right[n]] == pytest.approx([x for pair in right for x in pair], abs=1e-6)
    got = weak_rules.judge(weak_rules.with_counts(real), model).select("quality").collect()
    assert sorted(r["quality"] for r in got) == pytest.approx(sorted(q), abs=1e-6)


def test_accuracies_are_found_again(spark):
    """Votes drawn with known accuracies: the estimate comes near them without a label."""
    rng = random.Random(11)
    truth = {"a": (0.95, 0.8), "b": (0.9, 0.7), "c": (0.85, 0.85), "d": (0.99, 0.3)}
    rows = []
    for _ in range(6_000):
        y = rng.random() < 0.7
        rows.append([0 if rng.random() < 0.2 else (1 if (rng.random() < (p[0] if y else p[1])) == y else -1) for p in truth.values()])
    votes = spark.createDataFrame([(r,) for r in rows], "votes array<int>")
    model = weak_rules.fit(votes, list(truth))
    assert model.good == pytest.approx(0.7, abs=0.05)
    for n, p in truth.items():
        assert model.right[n] == pytest.approx(p, abs=0.07)


def test_quality_follows_labels(spark):
    out = weak_rules.op11(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    bad = [r["kept"] for r in out if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rule_edges(spark, odd, none, clashing):
    out, model = weak_rules.rate(none)
    assert out.count() == 0 and (model.good, model.right["length"]) == (weak_rules.START_GOOD, weak_rules.START_RIGHT)
    out, _ = weak_rules.rate(odd)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["base_failed"] and not r["kept"] for r in rows if not r["n_words"])
    named = clashing.withColumns({c: F.lit("x") for c in (*weak_rules.COUNTS, "quality", "kept", "base_failed")})
    out, _ = weak_rules.rate(named)
    assert out.count() == len(ROWS) and sorted(set(out.columns)) == sorted(out.columns)


# -- 12 ---------------------------------------------------------------------------------------


def nodes(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most", [1, 300, conversation_trie.TREE_BYTES])
def test_trie(spark, most):
    rng = random.Random(most)
    rows = []
    for c in [*range(0, 130), *range(200, 230), 305, 2**40, 2**40 + 7]:
        if c == 200:
            continue
        for t in range(rng.choice([0, 1, 2, 3, 4, 7, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if c % 3 else "user", rng.choice(["a", "bb", "日本", "long text here"]) if c % 2 else "a"))
    rows += [(400 + i, t, "user", "same") for i in range(60) for t in range(8)]  # copies
    rows += [(500 + i, t, "user", "first" if t == 0 else f"{i}") for i in range(60) for t in range(i % 7 + 1)]  # one first turn
    rows += [(601, None, None, None), (601, 3, "user", "x"), (601, 3, "user", "x"), (601, 3, "assistant", None), (601, -1, "", ""), (None, 1, "user", "nobody")]
    rows += [(603, t, "user", str(t % 3)) for t in range(400)]
    rng.shuffle(rows)
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    clash = conversations.withColumns({c: F.lit(1) for c in ("key", "name", "depth", "n", "part", "ends")})
    assert nodes(conversation_trie.build(clash, tree_bytes=most)) == brute.trie(rows)


def test_trie_query(spark):
    rows = list(map(tuple, spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert nodes(conversation_trie.op12(spark, SF_DIR)) == brute.trie(rows)


def test_trie_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert conversation_trie.build(spark.createDataFrame([], schema)).count() == 0
    assert conversation_trie.build(spark.createDataFrame([(None, 0, "user", "x")], schema)).count() == 0
    # 1: crc32 % 6 leaves its only turn out, and there is no head
    alone = next(c for c in range(1, 99) if __import__("zlib").crc32(str(c).encode()) % 6)
    (root,) = conversation_trie.build(spark.createDataFrame([(alone, 0, "user", "x")], schema)).collect()
    assert tuple(root)[:7] == (alone, 0, None, 1, 0, 1, 0)


def test_radix_tree_layouts():
    rng = random.Random(6)
    keys = {bytes(rng.choice((range(256), range(30), (1, 2))[rng.randrange(3)]) for _ in range(rng.randrange(1, 5))) for _ in range(4_000)}
    keys |= {b"zz" + bytes([b]) for b in range(0, 200, 5)}
    tree = conversation_trie.RadixTree()
    keys = sorted(keys)
    for i in rng.sample(range(len(keys)), len(keys)):
        tree.insert(keys[i], i)
    found, sizes, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        sizes.add(node.size)
        assert len(node.children()) <= node.size and (node is tree.root or node.end >= 0 or len(node.children()) > 1)
        if node.end >= 0:
            found.append(at)
            assert keys[node.end] == at
        stack += [(k, at + bytes([b]) + k.path) for b, k in reversed(node.children())]
    assert found == keys and sizes == {4, 16, 48, 256}


# -- 13 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_pieces(block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("aé日👩\n<") for _ in range(rng.randrange(40))) for _ in range(80)] + [""]
    low = np.array([rng.randrange(len(t) + 1) for t in texts])
    high = np.array([rng.randrange(a, len(t) + 1) for a, t in zip(low, texts)])
    sliced = pa.array(["before é", *texts], pa.string())[1:]
    got = list(zip(*[x.to_pylist() for x in fill_middle.pieces_of(sliced, low, high, block)]))
    assert got == [(t[:a], t[a:b], t[b:]) for t, a, b in zip(texts, low, high)]


def test_middle(spark, real, odd):
    more = [(10_000 + i, t) for i, t in enumerate(["<P> here", "x<S>", "<M", "<<S", "<P", ">", "<S" * 5, "日", "👩‍👩‍👧" * 3, "<" * 40] * 12)]
    docs = real.select("doc_id", "text").unionAll(odd.select("doc_id", "text")).unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    forms = set()
    for r in fill_middle.transform(docs).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute.fill_middle(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_middle_edges(spark, none, clashing):
    assert fill_middle.transform(none).count() == 0
    named = clashing.withColumns({c: F.lit("x") for c in ("n", "form", "output", "restored", "prefix_chars")})
    out = fill_middle.transform(named)
    assert out.count() == len(ROWS) and sorted(set(out.columns)) == sorted(out.columns)
    long = spark.createDataFrame([(3, "日本x" * 700_000)], "doc_id bigint, text string")
    r = fill_middle.transform(long).first()
    assert r["restored"] == "日本x" * 700_000 and (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute.fill_middle(3, "日本x" * 700_000)
    other = fill_middle.transform(long, transformed=100, suffix_first=100, marks=("[a]", "[b]", "[c]")).first()
    assert other["form"] == "spm" and other["output"].startswith("[b]") and other["restored"] == r["text"]
