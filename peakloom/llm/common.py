"""Helpers shared by the text operators.

Rows are identified by (doc_id, hash of the text), compared null-safe: rows that repeat both are the
same document seen again and get the same answer, rows that share only the id are kept apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from peakloom.plans.durable import discard, stored

# Text handled at once inside a task; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> list[Column]:
    """(doc_id, __h): what identifies a document between two reads of a table."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("__h")]


def join_on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join two tables that carry (doc_id, __h); the key columns of ``right`` are dropped."""
    r = right.withColumnsRenamed({"doc_id": "__rid", "__h": "__rh"})
    on = F.col("__h").eqNullSafe(F.col("__rh")) & F.col("doc_id").eqNullSafe(F.col("__rid"))
    return left.join(r, on, how).drop("__rid", "__rh")


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def annotate(df: DataFrame, fields: Sequence[tuple[str, str]], fn: Callable[[list], dict[str, list]], keep: Sequence[str] | None = None, most: int = PIECE_BYTES) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, without a shuffle.

    ``fn`` gets a list of texts (None for null), about ``most`` bytes of them, and returns one list per
    field. ``keep`` names the columns that travel along (all by default); a column that has the name of
    a new one is replaced.
    """
    names = [n for n, _ in fields]
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batch):
        got = fn(batch.column("__text").to_pylist())
        return [pa.array(got[n], type=t) for n, t in zip(names, kinds)]

    return append_columns(df, carried, {"__text": F.col("text")}, added, run, most)


def append_columns(df: DataFrame, carried: Sequence[str], inputs: dict[str, Column], added: T.StructType, run: Callable[[pa.RecordBatch], list[pa.Array]], most: int = PIECE_BYTES) -> DataFrame:
    """The carried columns plus those that ``run`` returns for batches of the input columns, the
    first of which is the text. Inside, columns go by number, so that any name will do. Workers serve
    other tasks later: what Arrow has set aside for a partition is given back at its end."""
    numbered = [f"_{i}" for i in range(len(carried))]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, numbered)], *[c.alias(n) for n, c in inputs.items()])
    schema = T.StructType([f for f in source.schema.fields if f.name not in inputs] + added.fields)
    new = [f.name for f in added.fields]
    by = next(iter(inputs))

    def batches_of(batches):
        for batch in pieces(batches, by, most):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in numbered] + run(batch), names=numbered + new)
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(batches_of, schema).toDF(*carried, *new)


# -- words of many texts at once -------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, dtype=bool)
for _range in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _WORD[slice(*_range)] = True
KEPT_POWERS = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; up to KEPT_POWERS of them are kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * (have[done - 1] * base)
                done += step
        if size <= KEPT_POWERS:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the words of text i as ``[bounds[i], bounds[i + 1])``.

    A word is a run of letters and digits, lower-cased; bytes from 128 on count as letters. The
    hash of a word depends on its bytes alone.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _WORD[joined]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(joined)))])
        hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(joined) + 1)[starts])
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, offsets)


# -- connected components --------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star steps until the edges no longer change. Each step takes a
    minimum per node (partially aggregated) and joins it back, so no neighbour list is collected.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(mark.alias("m")).first()["m"]
    if before[0] == 0:
        kind = now.schema["u"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, now = now, stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last, large)
        after = now.agg(mark.alias("m")).first()["m"]
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
