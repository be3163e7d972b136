"""Exact top-k inner products by distributed histogram selection.

Everything is scored, block of queries by block of candidates. A round counts, per query, how many
scores fall into each bin of the range that still holds the k-th best one; the counts are added up
over all blocks and the range shrinks to one bin. When few enough scores are left, rows at or above
its lower end are ranked, ties to the smaller id. Scores are integers, so nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import table
from peakloom.plans.durable import discard, stored
from peakloom.plans.joins import grown_join

TOP = 20
EVERY = 20
BINS = 256
QUERY_BLOCK, ROW_BLOCK = 4_096, 2_048
#: Scores a query may have at or above its lower bound, as a multiple of k, before ranking starts.
SLACK = 4
_TILE = 512
_LEAST = np.iinfo(np.int64).min
BLOCK = "block bigint, n bigint, norm double, kind string, ids binary, vectors binary"
#: Whole numbers travel in the narrowest of these types that holds them.
_KINDS = ("<i1", "<i2", "<i4")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and finite components throughout."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks of at most ``size``: ids and floor(64 x) as one buffer each."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, count = TaskContext.get().partitionId(), 0
        ids, vectors = [], []

        def block():
            nonlocal count
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v  # a shorter vector counts as ending in zeros
            m = np.floor(64.0 * m)
            count += 1
            most = np.abs(m).max(initial=0)
            kind = next((k for k in _KINDS if most <= np.iinfo(k).max), "<f8")
            row = {"block": [(part << 32) + count], "n": [len(ids)], "norm": [float(np.sqrt((m**2).sum(axis=1)).max())], "kind": [kind], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [m.astype(kind).tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("norm", pa.float64()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                ids.append(i)
                vectors.append(np.array(v, dtype=np.float64))
                if len(ids) == size:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, BLOCK)


def _unpack(kind: str, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    return i, np.frombuffer(vectors, dtype=kind).astype(np.float64).reshape(len(i), -1)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stay at the end of the range."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (q, c))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
    return np.clip(exact, _LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def _tiles(row: dict):
    """(positions of the queries, ids of candidates, scores) with each query's own row at the least value."""
    qids, q = _unpack(row["q_kind"], row["q_ids"], row["q_vectors"])
    cids, c = _unpack(row["kind"], row["ids"], row["vectors"])
    for at in range(0, len(qids), _TILE):
        s = scores(q[at : at + _TILE], c)
        mine = {}
        for j, i in enumerate(qids[at : at + _TILE].tolist()):
            mine.setdefault(i, []).append(j)
        for j in np.flatnonzero(np.isin(cids, qids[at : at + _TILE])).tolist():
            for i in mine[int(cids[j])]:
                s[i, j] = _LEAST
        yield at, qids, cids, s


def _paired(candidates: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, at: list) -> DataFrame:
    """Every block of candidates with every block of queries. Both are dealt out by (query block,
    salt), so neither side has to fit into a task or a broadcast. Files of blocks are small for their
    rows and say nothing of the salts, so the join is merged whatever their size."""
    spark = candidates.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(n_rows, -(-wanted // max(1, n_queries))))
    left = candidates.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(n_queries))))
    right = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right.hint("merge"), ["q", "salt"]).select("q", "q_kind", "q_ids", "q_vectors", *at, "kind", "ids", "vectors")


def top_k(embeddings: DataFrame, is_query, k: int = TOP, bins: int = BINS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for every query, all if there are fewer.

    ``is_query`` is a condition on the columns of ``embeddings``. A query's own id is no candidate.
    Null vectors, those with null or non-finite components and null ids take no part; a shorter
    vector counts as ending in zeros; rows that repeat are counted once. No queries, no rows.
    """
    rows = usable(embeddings).distinct()
    asked = usable(embeddings.where(is_query)).distinct()
    candidates = stored(pack(rows, row_block))
    blocks = stored(pack(asked, query_block))
    size = candidates.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("rows"), F.max("norm").alias("norm")).first()
    n_queries = blocks.count()
    if not n_queries:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    number = blocks.select("block").withColumn("q", F.row_number().over(Window.orderBy("block")))  # a row per block
    queries = stored(blocks.join(number.hint("merge"), "block").select("q", F.col("n").alias("q_n"), F.col("norm").alias("q_norm"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    # all scores lie within the product of the norms
    reach = F.least(F.ceil(F.col("q_norm") * F.lit(float(size["norm"])) + 1.0), F.lit((1 << 62) - 1)).cast("long")
    every = F.sequence(F.lit(0), (F.col("q_n") - 1).cast("int"))
    state = stored(queries.select("q", reach.alias("r"), F.explode(every).alias("pos")).select("q", "pos", (-F.col("r")).alias("lo"), F.col("r").alias("hi"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("done")))
    for _ in range(64):
        if state.where(~F.col("done")).isEmpty():
            break
        counts = _histogram(candidates, queries, state, size["blocks"], n_queries, bins)
        last, state = state, stored(_narrow(state, counts, k, bins))
        discard(last)
    else:
        raise RuntimeError("the k-th score was not found")
    bounds = state.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "lo"))).alias("b")).select("q", F.transform("b", lambda x: x["lo"]).alias("lo"))
    found = _paired(candidates, queries.join(bounds.hint("merge"), "q"), size["blocks"], n_queries, ["lo"]).mapInArrow(_above(k), "q int, pos int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q", "pos").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _histogram(candidates, queries, state, n_rows, n_queries, bins):
    """(q, pos, bin, n) over all candidates."""
    packed = state.withColumn("width", F.expr(f"(hi - lo) div {bins} + 1")).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi", "width", "done"))).alias("s"))
    packed = packed.select("q", *[_field(c) for c in ("lo", "hi", "width", "done")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi, width = (np.array(row[c], dtype=np.int64) for c in ("lo", "hi", "width"))
                live = ~np.array(row["done"])
                for at, _, _, s in _tiles(row):
                    part = slice(at, at + len(s))
                    inside = (s >= lo[part, None]) & (s <= hi[part, None]) & live[part, None]
                    i, j = np.nonzero(inside)
                    b = (s[i, j] - lo[part][i]) // width[part][i]
                    flat = np.bincount(i * bins + b, minlength=len(s) * bins)
                    hit = np.flatnonzero(flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(hit), row["q"], np.int32)), pa.array((at + hit // bins).astype(np.int32)), pa.array((hit % bins).astype(np.int32)), pa.array(flat[hit].astype(np.int64))],
                        names=["q", "pos", "bin", "n"],
                    )

    paired = _paired(candidates, queries.join(packed.hint("merge"), "q"), n_rows, n_queries, ["lo", "hi", "width", "done"])
    return paired.mapInArrow(run, "q int, pos int, bin int, n bigint").groupBy("q", "pos", "bin").agg(F.sum("n").alias("n"))


def _field(name):
    return F.transform("s", lambda x: x[name]).alias(name)


def _narrow(state, counts, k, bins):
    """Shrink every open range to the bin that holds the k-th best score."""
    down = Window.partitionBy("q", "pos").orderBy(F.col("bin").desc())  # at most ``bins`` rows
    cum = grown_join(counts, state.where(~F.col("done")), ["q", "pos"]).withColumn("from_top", F.sum("n").over(down) + F.col("above"))
    hit = cum.where((F.col("from_top") >= k) & (F.col("from_top") - F.col("n") < k))
    moved = hit.select(
        "q", "pos", F.expr(f"lo + bin * ((hi - lo) div {bins} + 1)").alias("lo2"), F.expr(f"least(hi, lo + (bin + 1) * ((hi - lo) div {bins} + 1) - 1)").alias("hi2"),
        (F.col("from_top") - F.col("n")).alias("above2"), (F.col("from_top") <= SLACK * k).alias("few"),
    )
    out = grown_join(state, moved, ["q", "pos"], "left")
    # a query without k scores in all keeps everything from its lower end on
    found = F.col("lo2").isNotNull()
    return out.select(
        "q", "pos", F.when(found, F.col("lo2")).otherwise(F.col("lo")).alias("lo"), F.when(found, F.col("hi2")).otherwise(F.col("hi")).alias("hi"),
        F.when(found, F.col("above2")).otherwise(F.col("above")).alias("above"),
        F.col("done") | ~found | F.col("few") | (F.col("lo2") == F.col("hi2")),
    ).toDF("q", "pos", "lo", "hi", "above", "done")


def _above(k: int):
    """Rows at or above each query's bound; of those the ``k`` best of a block of candidates, which
    is all that can be among the ``k`` best in the end."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lo = np.array(row["lo"], dtype=np.int64)
                for at, qids, cids, s in _tiles(row):
                    i, j = np.nonzero((s >= lo[at : at + len(s), None]) & (s != _LEAST))
                    value, who = s[i, j], cids[j]
                    order = np.lexsort((who, -value, i))
                    i, value, who = i[order], value[order], who[order]
                    first = np.searchsorted(i, np.arange(len(s)))
                    keep = np.arange(len(i)) - first[i] < k
                    i, value, who = i[keep], value[keep], who[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), row["q"], np.int32)), pa.array((at + i).astype(np.int32)), pa.array(qids[at + i]), pa.array(who), pa.array(value)],
                        names=["q", "pos", "query_id", "vec_id", "score"],
                    )

    return run


def op7(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % EVERY == 0)


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding]), true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
