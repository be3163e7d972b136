"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

Bytes are written as printable characters (the byte table), merges run on those, and decoding goes
back from characters to bytes. A character may be split between tokens: its bytes are put together
again before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.common import annotate, append_columns, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A vocabulary file beyond this size is refused; it is sent to every executor.
MAX_VOCABULARY_BYTES = 64_000_000
# Text encoded at once inside a task, with some hundred bytes per token; a longer text is a piece of its own.
PIECE_BYTES = 256_000
#: Words whose ids a Python worker remembers, the longest word that is remembered, and how many are looked up at once.
MEMO_WORDS, MEMO_CHARS, WORDS_AT_ONCE = 1 << 18, 64, 1 << 16
# Patterns by which ``regex``, in a fifth of the time, splits as the library does, but for characters that no
# common version of Unicode assigns (tested on every code point). The library splits such texts, and all texts
# by other patterns.
ALIKE = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])


def byte_table() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 bytes stand for themselves, the others follow
    from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token and rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that ``token`` is made of when only tokens of lower rank may be merged."""
    own = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(options)
        if rank >= own:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"not a BPE vocabulary: {token!r} can't be merged from tokens of lower rank")
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the library that merges as the ranks say and splits by ``pattern`` first."""
    chars = byte_table()
    name = lambda token: "".join(chars[b] for b in token)
    ordered = sorted(ranks, key=ranks.get)
    merges = [[*map(name, last_merge(t, ranks))] for t in ordered if len(t) > 1]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {name(t): ranks[t] for t in ordered}, "merges": merges,
    }
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": level, "model": model,
    })


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        # the same model for words that are cut already
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        pattern = json.loads(data)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern) if pattern in ALIKE else None
        self.assigned: set[str] = set()
        self.known: dict[str, bytes] = {}
        back = {c: b for b, c in byte_table().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)

    def encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode_with_offsets(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def pack(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; words that recur are merged once."""
        plain = [self._is_plain(t) for t in texts]
        small = [self.cut.findall(t) if p and len(t) <= PIECE_BYTES else [] for t, p in zip(texts, plain)]
        found = self._ids_of(set(itertools.chain.from_iterable(small)))
        out = [b"".join(map(found.__getitem__, words)) for words in small]
        for i, (text, p) in enumerate(zip(texts, plain)):
            if not p:
                out[i] = _packed(self.encode([text])[0].ids)
            elif len(text) > PIECE_BYTES:
                out[i] = b"".join(self._pack_long(text))
        return out

    def _is_plain(self, text: str) -> bool:
        """Whether ``regex`` cuts ``text`` as the library does."""
        if self.cut is None or text.isascii():
            return self.cut is not None
        new = set(text) - self.assigned
        bad = any(unicodedata.category(c) == "Cn" for c in new)
        if not bad:
            self.assigned |= new
        return not bad

    def _pack_long(self, text: str):
        words = (m.group() for m in self.cut.finditer(text))
        while part := list(itertools.islice(words, WORDS_AT_ONCE)):
            yield b"".join(map(self._ids_of(set(part)).__getitem__, part))

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of at least these words."""
        new = list(words.difference(self.known))
        if not new:
            return self.known
        if len(self.known) + len(new) > MEMO_WORDS:
            self.known, new = {}, list(words)
        ids = dict(zip(new, (_packed(e.ids) for e in self.of_words.encode_batch_fast(new, add_special_tokens=False))))
        if max(map(len, new)) <= MEMO_CHARS:
            self.known.update(ids)
            return self.known
        found = {w: ids.get(w) or self.known[w] for w in words}
        self.known.update((w, i) for w, i in ids.items() if len(w) <= MEMO_CHARS)
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Packed:
    """A codec on its way: unpickled, it is the loaded codec. As the value of a broadcast it is loaded
    once per Python worker and dropped when the worker goes on to jobs without it."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return Codec, (self.data,)


def clean(text: str | None) -> str:
    """Null as the empty text; lone surrogates, which UTF-8 can't hold, as the replacement mark."""
    return (text or "").encode("utf-8", "replace").decode("utf-8")


_json: dict[str, bytes] = {}


def load(spark: SparkSession, path: str, pattern: str):
    """Broadcast codec for the vocabulary file at ``path`` on the driver."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        data = f.read()
    mark = hashlib.md5(data + pattern.encode()).hexdigest()
    if mark not in _json:
        _json[mark] = tokenizer_json(read_ranks(data), pattern).encode("utf-8")
    return spark.sparkContext.broadcast(Packed(_json[mark]))


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``ids`` and, on request, ``starts`` and ``ends``: the range of
    characters each token touches (two tokens that share a character both have it).

    Null texts are encoded as the empty text, which has no tokens. Columns of the same names are
    replaced.
    """
    shipped = load(docs.sparkSession, path, pattern)

    def run(texts):
        c = shipped.value
        texts = [clean(t) for t in texts]
        if not offsets:
            return {"ids": [e.ids for e in c.encode(texts)]}
        got = c.encode_with_offsets(texts)
        return {"ids": [e.ids for e in got], "starts": [[o[0] for o in e.offsets] for e in got], "ends": [[o[1] for o in e.offsets] for e in got]}

    fields = [("ids", "array<int>")] + [("starts", "array<int>"), ("ends", "array<int>")] * offsets
    return annotate(docs, fields, run, most=PIECE_BYTES)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``tokens`` plus ``decoded_bytes`` and ``decoded``, from ``ids``.

    Null ids give null. Bytes that are no UTF-8, as when the ids end inside a character, become the
    replacement mark in ``decoded``; ``decoded_bytes`` always has them as they are.
    """
    shipped = load(tokens.sparkSession, path, pattern)
    tokens = tokens.drop("decoded_bytes", "decoded")

    def run(batch):
        c = shipped.value
        raw = [None if i is None else c.decode(i) for i in batch.column("__ids").to_pylist()]
        return [pa.array(raw, pa.binary()), pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())]

    added = T.StructType([T.StructField("decoded_bytes", T.BinaryType()), T.StructField("decoded", T.StringType())])
    # batches are cut by the size of the written ids
    inputs = {"__size": F.col("ids").cast("string"), "__ids": F.col("ids")}
    return append_columns(tokens, tokens.columns, inputs, added, run, PIECE_BYTES)


def round_trip(docs: DataFrame, path: str, pattern: str, keep=None) -> DataFrame:
    """The kept columns plus ``n_tokens``, ``packed_ids`` (little-endian unsigned 32-bit) and
    ``decoded_bytes``: encoding and decoding in one pass over the texts."""
    shipped = load(docs.sparkSession, path, pattern)

    def run(texts):
        c = shipped.value
        packed = c.pack([clean(t) for t in texts])
        decoded = [c.decode(struct.unpack(f"<{len(p) // 4}I", p)) for p in packed]
        return {"n_tokens": [len(p) // 4 for p in packed], "packed_ids": packed, "decoded_bytes": decoded}

    fields = [("n_tokens", "bigint"), ("packed_ids", "binary"), ("decoded_bytes", "binary")]
    return annotate(docs, fields, run, keep=keep, most=PIECE_BYTES)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op10(spark, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens; the text is what the tokens decode to."""
    names = {c: f"__in_{c}" for c in ("n_tokens", "packed_ids", "decoded_bytes", "ids_sha256") if c in docs.columns}
    out = round_trip(docs.withColumnsRenamed(names), *vocabulary())
    columns = [F.decode("decoded_bytes", "UTF-8").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*columns, "n_tokens", "packed_ids", F.sha2("packed_ids", 256).alias("ids_sha256"))
