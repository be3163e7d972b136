"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; positions marked 0 are ignored, so a substituted
word under a 0 does not break the hit. Seeds of the benchmark items are joined with seeds of the
documents. Around each hit document and item are compared word by word on the hit's diagonal: the
overlap is every window of ``window`` words (the whole item, if it is shorter) with at least
``similarity`` of its words equal. Items shorter than the window have masks of their own length, which
hit every pattern of substitutions that ``similarity`` allows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import annotate, join_on_key, mix, row_key, table, word_hashes

MASKS = ("11011011", "110100111", "1110010101")
WINDOW = 13
SIMILARITY = 0.8
#: Overlaps of fewer words can't tell a leak from a common phrase: they are found, but remove no document.
TELLING_WORDS = 5
#: Text scanned at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 256_000
#: Words that agree in a seed of a short item at least, if its length allows.
LEAST_WEIGHT = 4
#: Words of benchmark text that are sent to every task; a larger benchmark is joined by shuffle.
BROADCAST_WORDS = 2_000_000
_ODD = np.array([2 * i * 0x9E3779B1 + 0x85EBCA77 | 1 for i in range(64)], dtype=np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the 1s of ``mask`` for every start position."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p, bit in enumerate(mask):
            if bit == "1":
                total += mix(words[p : p + n] ^ _ODD[p % 64]) * _ODD[(p * 7 + 3) % 64]
    return mix(total)


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks over all ``n`` words of a short item, one of which avoids any substitutions that are allowed.

    The words are cut into blocks and as many blocks ignored as words may differ; the blocks are the
    fewest that leave LEAST_WEIGHT words to agree.
    """
    free = n - max(0, math.ceil(similarity * n - 1e-9))
    if free <= 0:
        return ["1" * n]
    for blocks in range(min(free + 2, n), n + 1):
        edges = [n * i // blocks for i in range(blocks + 1)]
        masks = []
        for gone in combinations(range(blocks), min(free, blocks)):
            masks.append("".join(("0" if i in gone else "1") * (edges[i + 1] - edges[i]) for i in range(blocks)))
        if min(m.count("1") for m in masks) >= LEAST_WEIGHT:
            break
    return masks


def masks_for(lengths: Sequence[int], masks: Sequence[str] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> list[tuple[str, int]]:
    """(mask, length of the items it is for): the given masks for items of ``window`` words or more,
    which are length 0 here, and those of every shorter length that occurs."""
    short = sorted({n for n in lengths if 0 < n < max(window, min(map(len, masks)))})
    return [*((m, 0) for m in masks), *((m, n) for n in short for m in (short_masks(n, similarity) if n < window else ["1" * n]))]


def _meant(mask: tuple[str, int], n: int, window: int) -> bool:
    return mask[1] == n or (mask[1] == 0 and n >= window)


def overlaps(words: np.ndarray, item: np.ndarray, diagonal: int, window: int, similarity: float) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of the verified overlaps on a diagonal, in document positions."""
    size = min(window, len(item))
    lo, hi = max(0, diagonal), min(len(words), diagonal + len(item))
    if hi - lo < size or size == 0:
        return []
    same = words[lo:hi] == item[lo - diagonal : hi - diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= np.ceil(similarity * size - 1e-9))
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1):
        if len(run):
            s, e = int(run[0]), int(run[-1]) + size
            out.append((lo + s, lo + e, int(sums[e] - sums[s])))
    return out


def _item_words(benchmark: DataFrame) -> DataFrame:
    def run(texts):
        hashes, bounds = word_hashes(texts)
        signed = hashes.astype(np.int64)
        return {"words": [signed[a:b].tolist() for a, b in zip(bounds, bounds[1:])]}

    items = annotate(benchmark.select("item_id", "text"), [("words", "array<bigint>")], run, keep=["item_id"])
    return items.where(F.size("words") > 0)


LEAK = "array<struct<item_id:{0},start:int,end:int,equal:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``leaks``: the benchmark items found in the text, with the range
    of words (from 0, end exclusive) and how many of them are equal.

    Null and empty texts and an empty benchmark give empty lists; items without words, null
    ones too, are never found; items under 5 words only as a whole, word by word. Items that repeat are
    reported once for each of their rows, whatever the size of the benchmark. A column named leaks is
    replaced.
    """
    docs = docs.drop("leaks")
    items = _item_words(benchmark)
    kind = dict(items.dtypes)["item_id"]
    size = items.agg(F.sum(F.size("words"))).first()[0] or 0
    if size > broadcast_words:
        return _by_shuffle(docs, items, kind, masks, window, similarity)
    rows = items.collect()
    ids = [r["item_id"] for r in rows]
    words = [np.array(r["words"], dtype=np.int64).astype(np.uint64) for r in rows]
    used = masks_for([len(w) for w in words], masks, window, similarity)
    shipped = docs.sparkSession.sparkContext.broadcast((ids, words, used))
    ready: list = []

    def run(texts):
        if not ready:
            ready.append(_index(shipped.value[1], shipped.value[2], window))
        return {"leaks": _scan(texts, shipped.value, ready[0], window, similarity)}

    return annotate(docs, [("leaks", LEAK.format(kind))], run, keep=docs.columns, most=PIECE_BYTES)


def _index(words: list[np.ndarray], masks: Sequence[tuple[str, int]], window: int):
    """Per mask: sorted seeds, their items and positions, and a bitmap that most misses fail."""
    out = []
    for mask in masks:
        per = [seed_hashes(w, mask[0]) if _meant(mask, len(w), window) else np.zeros(0, np.uint64) for w in words]
        seeds = np.concatenate([*per, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(words)), [len(p) for p in per])
        at = np.concatenate([*(np.arange(len(p)) for p in per), np.zeros(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(seeds >> np.uint64(44)).astype(np.int64)] = True
        out.append((mask[0], seeds[order], item[order], at[order].astype(np.int64), bitmap))
    return out


def _scan(texts, benchmark, index, window, similarity):
    ids, items, _ = benchmark
    words, bounds = word_hashes(texts)
    found: list[dict] = [{} for _ in texts]
    for mask, seeds, item, at, bitmap in index:
        if not len(seeds):
            continue
        h = seed_hashes(words, mask)
        maybe = np.flatnonzero(bitmap[(h >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(seeds, h[maybe], side="left")
        hi = np.searchsorted(seeds, h[maybe], side="right")
        real = np.flatnonzero(hi > lo)
        owner = np.searchsorted(bounds, maybe[real], side="right") - 1
        for k, doc in zip(real.tolist(), owner.tolist()):
            start = int(maybe[k])
            if start + len(mask) > bounds[doc + 1]:
                continue  # the seed runs into the next text
            for j in range(lo[k], hi[k]):
                found[doc].setdefault((int(item[j]), start - int(bounds[doc]) - int(at[j])), None)
    out = []
    for i, keys in enumerate(found):
        own = words[bounds[i] : bounds[i + 1]]
        spans = sorted({(k, s, e, n) for k, d in keys for s, e, n in overlaps(own, items[k], d, window, similarity)})
        out.append([{"item_id": ids[k], "start": s, "end": e, "equal": n} for k, s, e, n in spans])
    return out


def _by_shuffle(docs, items, kind, masks, window, similarity) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet in a join."""
    lengths = [r[0] for r in items.where(F.size("words") < max(window, min(map(len, masks)))).select(F.size("words")).distinct().collect()]
    used = masks_for(lengths, masks, window, similarity)

    def of_words(words):
        return [(h, p) for m in used if _meant(m, len(words), window) for p, h in enumerate(seed_hashes(words, m[0]).astype(np.int64).tolist())]

    def of_texts(texts):
        words, bounds = word_hashes(texts)
        out = []
        for a, b in zip(bounds, bounds[1:]):
            out.append([{"seed": h, "p": p} for m in used for p, h in enumerate(seed_hashes(words[a:b], m[0]).astype(np.int64).tolist())])
        return {"seeds": out}

    items = items.groupBy("item_id", "words").agg(F.count(F.lit(1)).alias("copies")).withColumn("item", F.xxhash64("item_id", "words"))

    def item_seeds(batches):
        import pyarrow as pa

        for batch in batches:
            for key, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                got = of_words(np.array(words, dtype=np.int64).astype(np.uint64))
                yield pa.RecordBatch.from_pydict({"item": pa.array([key] * len(got), pa.int64()), "seed": pa.array([h for h, _ in got], pa.int64()), "q": pa.array([p for _, p in got], pa.int32())})

    right = items.select("item", "words").dropDuplicates(["item"]).mapInArrow(item_seeds, "item bigint, seed bigint, q int")
    keyed = docs.withColumn("__h", row_key()[1])
    left = annotate(keyed.select("doc_id", "__h", "text"), [("seeds", "array<struct<seed:bigint,p:int>>")], of_texts, keep=["doc_id", "__h"])
    left = left.select("doc_id", "__h", F.explode("seeds").alias("s")).select("doc_id", "__h", "s.seed", "s.p")
    hits = left.join(right, "seed").select("doc_id", "__h", "item", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    per = hits.groupBy("doc_id", "__h", "item").agg(F.collect_list("diagonal").alias("diagonals")).join(items, "item")
    per = per.groupBy("doc_id", "__h").agg(F.collect_list(F.struct("item_id", "words", "copies", "diagonals")).alias("__items"))
    joined = join_on_key(keyed, per, "left")
    spans = _verified(window, similarity, LEAK.format(kind))
    return joined.withColumn("leaks", spans("text", "__items")).drop("__h", "__items")


def _verified(window, similarity, returns):
    @F.udf(returnType=returns, useArrow=True)
    def spans(text, items):
        words, _ = word_hashes([text])
        out: list = []
        for r in items or ():
            item = np.array(r["words"], dtype=np.int64).astype(np.uint64)
            out += [(r["item_id"], *o) for o in {o for d in r["diagonals"] for o in overlaps(words, item, d, window, similarity)}] * r["copies"]
        return [dict(zip(("item_id", "start", "end", "equal"), o)) for o in sorted(out, key=repr)]

    return spans


def op1(spark, sf_dir: str) -> DataFrame:
    """One row for each leak of an item into a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.col("l.start").alias("start_word"), F.col("l.end").alias("end_word"), F.col("l.equal").alias("n_equal"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of TELLING_WORDS words or more."""
    renamed = docs.withColumnRenamed("leaks", "__in_leaks")
    telling = F.exists("leaks", lambda l: l["end"] - l["start"] >= TELLING_WORDS)
    kept = find_leaks(renamed, table(spark, sf_dir, "benchmark")).where(~telling).drop("leaks")
    return kept.withColumnRenamed("__in_leaks", "leaks").select(*[F.col(f"`{c}`") for c in docs.columns])
