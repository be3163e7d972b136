"""Token counts without tokens: byte-pair merging on a heap and a linked list.

The symbols of a word form a linked list; a heap holds the adjacent pairs that may be merged, the
lowest rank first, the leftmost first among equals. Every pop that is still valid removes one symbol,
so the count is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import hashlib
import json
import os
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.bpe import MAX_VOCABULARY_BYTES, byte_table, clean
from peakloom.llm.common import annotate, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2_048
#: Counts of words remembered by a Python worker, and the longest word that is remembered.
MEMO_WORDS, MEMO_CHARS = 1 << 19, 64
_loaded: dict[str, "Counter"] = {}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the lowest-rank adjacent pair is merged again and again."""
    n = len(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    symbols = list(symbols)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[i] = left + right
        symbols[j] = ""  # never part of a pair again
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0:
                pair = (symbols[a], symbols[after[a]])
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], a, *pair))
    return n - merges


class Counter(dict):
    """Word to token count; counts are worked out when first asked for."""

    def __init__(self, data: bytes):
        super().__init__()
        spec = json.loads(data)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        known = (
            model["type"] == "BPE" and not model.get("dropout") and not model["continuing_subword_prefix"]
            and not model["byte_fallback"] and not model["ignore_merges"] and model["unk_token"] is None
            and steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError("only word-end BPE vocabularies with NFC, blank folding and lower case are supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {}
        for rank, pair in enumerate(pairs):
            self.ranks[pair] = rank  # a pair that is listed twice has its last place
        self.suffix = model["end_of_word_suffix"] or ""
        self.chars = byte_table()
        if not all(c in model["vocab"] and c + self.suffix in model["vocab"] for c in self.chars.values()):
            raise ValueError("a byte has no symbol")
        self.words = regex.compile(split[0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        symbols = [self.chars[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = merged_length(symbols, self.ranks)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n

    def of_segment(self, text: str) -> int:
        if not text.isascii():
            # lower case goes character by character; Python alone looks at the end of a word for sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # runs of blanks are dropped by the split whatever they are folded to
        text = text.lower()
        return sum(map(self.__getitem__, self.words.findall(text)))

    def of_text(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token and ends the text before it."""
        if self.special is None or "<" not in text:
            return self.of_segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.of_segment(p) for p in parts if p)


def count_tokens(docs: DataFrame, path: str, keep=None) -> DataFrame:
    """The kept columns (all by default) plus ``n_bytes`` and ``n_tokens``.

    Null counts as the empty text: no bytes, no tokens. Columns of these names are replaced.
    """
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        data = f.read()
    mark = hashlib.md5(data).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(texts):
        if mark not in _loaded:
            _loaded.clear()
            _loaded[mark] = Counter(shipped.value)
        count = _loaded[mark]
        texts = [clean(t) for t in texts]
        return {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [count.of_text(t) for t in texts]}

    return annotate(docs, [("n_bytes", "bigint"), ("n_tokens", "bigint")], run, keep=keep)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY), keep=["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
