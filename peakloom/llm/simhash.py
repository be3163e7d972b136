"""Near-duplicates by 64-bit SimHash, joined with the generalised pigeonhole principle.

The bits are grouped into m partitions, correlated bits together. If two fingerprints differ in at
most tau bits, then for any thresholds t_1..t_m >= -1 that add up to tau - m + 1 some partition
differs in at most t_i bits (a partition with -1 is not probed). The thresholds, and m, come from a
dynamic programme over candidate counts estimated from the fingerprints. Candidates meet in a join
on the partition's bits and are verified there.

A bucket that many fingerprints probe is not enumerated. Its fingerprints look for partners by the
centres of small Hamming balls instead: all that share a centre are within tau of each other, so a
star replaces the pairs. Both ways are exact, and work stays in proportion to the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import annotate, components, join_on_key, row_key, table
from peakloom.llm.minhash import near_copies
from peakloom.plans.durable import discard, stored

WORDS = 3
SEED = 42
MAX_BITS = 2
#: Probes of a bucket beyond which its fingerprints are linked by stars instead of pairs.
BUCKET = 64
#: Fingerprints the candidate counts are estimated from. Decides the plan, never the result.
SAMPLE = 2_048
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit is 1 where over half of the shingle hashes have it; 0 without words. As a signed 64-bit value."""
    # bytes.lower touches A-Z only, bytes.split cuts at 0x20 and 0x09-0x0D
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) >= words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, dtype=np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        s, e = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.array([h64(joined[i:j], seed) for i, j in zip(s, e)], dtype=np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, __h, fp) for every row."""
    narrow = docs.select(*row_key(), "text")
    run = lambda texts: {"fp": [fingerprint(t, words, seed) for t in texts]}
    return annotate(narrow, [("fp", "bigint")], run, keep=["doc_id", "__h"])


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Split the 64 bits into ``m`` groups of nearly equal size, correlated bits together."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1.0
    tie = np.abs((centred / spread).T @ (centred / spread))
    free, groups = set(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, groups))) // (m - i)
        left = sorted(free)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (tie[b, group].sum(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds (-1 to tau) per partition that add up to tau - m + 1 at the least total cost.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, tau + 1):
                option = (cost + row[t + 1], [*chosen, t])
                if total + t not in step or option < step[total + t]:
                    step[total + t] = option
        best = step
    return best[tau - m + 1][1]


def flips(bits: list[int], most: int) -> list[int]:
    """All ways to change at most ``most`` of the given bits, as signed masks."""
    masks = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, the cheapest over one to tau + 2 partitions."""
    best = None
    s = len(sample)
    scale = n * max(n - 1, 1) / max(1, s * (s - 1))
    for m in range(1, tau + 3):
        groups, costs = group_bits(sample, m), []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            seen = np.zeros(tau + 1)
            for at in range(0, s, 256):
                d = np.bitwise_count((sample[at : at + 256, None] ^ sample[None, :]) & mask)
                seen += [np.count_nonzero(d <= t) for t in range(tau + 1)]
            # a bucket costs its pairs or, beyond BUCKET, a star of 65 rows for each fingerprint
            pairs = [min((x - s) * scale / 2, 65.0 * n) for x in seen]
            # fingerprints too alike to be seen in the sample still meet at random
            random = [n * n / 2 / 2.0 ** len(bits) * len(flips(bits, t)) for t in range(tau + 1)]
            costs.append([0.0] + [max(pairs[t], min(random[t], 65.0 * n)) + n * (1 + len(flips(bits, t))) for t in range(tau + 1)])
        chosen = allocate(costs, tau)
        total = sum(c[t + 1] for c, t in zip(costs, chosen))
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def links(fps: DataFrame, tau: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints such that the components are those of all pairs
    that differ in at most ``tau`` bits. Every edge is such a pair."""
    if tau not in (0, 1, 2):
        raise ValueError("tau must be 0, 1 or 2")
    n = fps.count()
    ticket = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30))
    share = min(1.0, 2.0 * SAMPLE / max(n, 1))
    rows = fps.select("fp").where(ticket < F.lit(int(share * (1 << 30)))).limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).astype(np.uint64)
    if tau == 0 or n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = plan(sample, n, tau) if len(sample) > 1 else [(list(range(64)), tau)]
    masks = [sum(1 << b for b in bits) for bits, _ in parts]
    masks = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    home = lambda i: F.col("fp").bitwiseAND(F.lit(masks[i]).cast("long"))
    place = lambda i, key: F.struct(F.lit(i).alias("part"), key.alias("key"))
    homes = fps.select("fp", F.explode(F.array(*[place(i, home(i)) for i in range(len(parts))])).alias("k")).select("fp", "k.*")
    probe = lambda i: F.transform(F.array(*[F.lit(x).cast("long") for x in flips(*parts[i])]), lambda x: place(i, home(i).bitwiseXOR(x)))
    around = F.flatten(F.array(*[probe(i) for i in range(len(parts))]))
    probes = fps.select("fp", F.explode(around).alias("k")).select("fp", "k.*")
    crowded = stored(probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("part", "key"))
    at = ["part", "key"]
    # the crowded buckets are out before rows are dealt by bucket, so no bucket is large then
    some = probes.join(crowded, at, "left_anti").repartition(*at).withColumnRenamed("fp", "a")
    other = homes.join(crowded, at, "left_anti").repartition(*at).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau
    pairs = some.join(other, at).where((F.col("a") < F.col("b")) & near).select("a", "b")
    dense = probes.join(crowded, at, "left_semi").select("fp").distinct()
    centres = F.array(*[F.lit(x).cast("long") for x in flips(list(range(64)), tau // 2)])
    balls = dense.select("fp", F.explode(centres).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("c"), F.lit(-1).alias("bit"))
    if tau % 2:
        without = F.expr("transform(sequence(0, 63), i -> named_struct('bit', i, 'c', c & ~shiftleft(1L, i)))")
        balls = balls.select("fp", F.explode(without).alias("w")).select("fp", "w.c", "w.bit")
    # at most as many fingerprints share a centre as there are changes of a ball
    stars = balls.groupBy("c", "bit").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, __h, fp, root, component_id) for every row of ``docs``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is the
    smallest doc_id that can be reached, root a fingerprint that names the component. A null text
    and one without words have fingerprint 0 and are linked like any other. Null ids take part, but
    are never the smallest; a component of null ids only has a null component_id. Rows that repeat
    give repeated rows. An empty table gives no rows.
    """
    base = stored(fingerprints(docs, words, seed))
    fps = stored(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(fps, max_bits))
    rooted = stored(fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    reps = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(reps, "root"))
    discard(fps)
    return base.join(named, "fp").select("doc_id", "__h", "fp", "root", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (5-word shingles, similarity 0.8): the one with the
    smallest id. The 2 bits of :func:`op9` would find few pairs of that similarity."""
    found = near_copies(docs)
    rows = found.groupBy("doc_id", "__h", "root").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h", "n")).alias("r"))
    first = stored(first.select("r.doc_id", "r.__h", "r.n"))
    kept = join_on_key(docs.withColumn("__h", row_key()[1]), first.select("doc_id", "__h"), "left_semi")
    if not first.where("n > 1").isEmpty():
        # the same row several times: one of them stays
        kept = kept.dropDuplicates(["doc_id", "__h"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
