"""Ids by words that are cut once and remembered are those of the library."""

import random
import struct
import time
import unicodedata

import pytest

from peakloom.llm import bpe


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.vocabulary()
    return bpe.Codec(bpe.tokenizer_json(bpe.read_ranks(open(path, "rb").read()), pattern).encode())


def by_library(codec, texts):
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in codec.encode(texts)]


def test_both_engines_cut_alike(codec):
    from tokenizers import Regex, pre_tokenizers

    pattern = bpe.vocabulary()[1]
    assert pattern in bpe.ALIKE and codec.cut is not None
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    for at in range(0, len(points), 2_000):
        text = "".join(f"a{c}b1{c}2 {c} .{c}" for c in points[at : at + 2_000])
        assert [w for w, _ in split.pre_tokenize_str(text)] == codec.cut.findall(text)


def test_pack_equals_the_library(codec, monkeypatch):
    rng = random.Random(7)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    usual = " '\n\t\r  stlldvem12.,-aé \x1c\x85"
    texts = ["".join(rng.choice(points) if rng.random() < share else rng.choice(usual) for _ in range(rng.randrange(200))) for share in (0, 0.01, 0.3) for _ in range(300)]
    texts += ["", "'s's x", "a՘b 1", "x" * 200 + " y", "x y é " * 60_000, " " * 1_000]
    want = by_library(codec, texts)
    assert codec.pack(texts) == want
    # few words are remembered, short parts, one text at a time
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    monkeypatch.setattr(bpe, "MEMO_CHARS", 3)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 40)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 4)
    codec.known.clear()
    assert [i for t in texts for i in codec.pack([t])] == want
    monkeypatch.setattr(codec, "cut", None)
    assert codec.pack(texts[:50]) == want[:50]


def test_recurring_words_are_not_merged_again(codec):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 12))) for _ in range(2_000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(500)]
    start = time.process_time()
    want = by_library(codec, texts)
    middle = time.process_time()
    assert codec.pack(texts) == want
    assert time.process_time() - middle < 0.6 * (middle - start)
