"""Exact removal of long repeated byte strings by external induced suffix sorting.

1. Every window of ``length`` bytes has an anchor, the least hash among its ``gram``-byte pieces. It
   depends on the window's bytes alone, so equal windows have equal anchors at equal offsets.
   Windows in a row that share an anchor form one stretch. A stretch whose anchor occurs once in
   the corpus holds no repeated window; one that occurs again as it is is repeated throughout.
2. The other stretches of an anchor are compared in shards dealt by anchor, aligned on it. The order
   of the suffixes at one offset is induced from that at the next one: tuples (stretch, common prefix
   with the predecessor) pass through a priority queue keyed by their byte, first in first out among
   equals, and come out as the tuples of this offset. Queue and text columns are kept on disk
   beyond a bound, so a shard may be far larger than memory. Windows whose common prefix with a
   neighbour reaches ``length`` are repeated.
3. An anchor with very many different stretches is not given to one shard: its windows are counted
   by hash over the cluster, whole blocks of them first.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from peakloom.llm.common import _BASE, _INVERSE, _power, append_columns, join_on_key, mix, pieces, row_key, table
from peakloom.plans.durable import stored

LENGTH = 200
GRAM = 100
#: Different stretches of an anchor beyond which its windows are counted over the cluster.
CROWDED = 256
#: Window starts of a crowded stretch that are compared together first.
BLOCK = 8
#: Window starts of a text looked at together.
CHUNK = 1 << 20
#: Tuples a queue holds in memory, and bytes of text columns, before they go to disk.
QUEUE_TUPLES = 1 << 22
COLUMN_BYTES = 1 << 26


# -- stretches -------------------------------------------------------------------------------


def _sums(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)))])


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], from its bytes alone."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """Position of the leftmost least value in every window of ``reach`` values.

    Minima from both ends of blocks as long as a window; the low bits hold the place in the block,
    so that equal values go to the left one.
    """
    n = len(grams) - reach + 1
    low = np.uint64((1 << reach.bit_length()) - 1)
    blocks = -(-len(grams) // reach) + 1
    packed = np.full(blocks * reach, ~np.uint64(0))
    packed[: len(grams)] = grams
    packed = (packed & ~low).reshape(blocks, reach) | np.arange(reach, dtype=np.uint64)
    before = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # from here to the end of the block
    upto = np.minimum.accumulate(packed, axis=1).reshape(-1)
    i = np.arange(n)
    left, right = before[:n], upto[reach - 1 : reach - 1 + n]
    own = i // reach * reach
    last = (i + reach - 1) // reach * reach
    return np.where((left | low) <= (right | low), own + (left & low).astype(np.int64), last + (right & low).astype(np.int64))


def stretches(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, stretch hash, start, end, anchor position) of the stretches of a text."""
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        sums = _sums(part)
        place = np.arange(len(part) - gram + 1)
        where = anchors(_hash(sums, place, place + gram), length - gram + 1)
        start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        end = np.concatenate([start[1:], [len(where)]]) + length - 1
        anchor = where[start]
        whole = mix(_hash(sums, start, end) ^ (anchor - start).astype(np.uint64))
        yield _hash(sums, anchor, anchor + gram), whole, at + start, at + end, at + anchor


def _raw(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _stretch_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, __h, anchor, stretch, start, end, middle) for all stretches of all documents."""
    narrow = docs.select(*row_key(), "text")

    def run(batches):
        for batch in pieces(batches):
            rows, parts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for part in stretches(_raw(text), length, gram):
                    rows.append(np.full(len(part[0]), i))
                    parts.append(part)
            if rows:
                who = pa.array(np.concatenate(rows))
                a, s, start, end, middle = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("__h").take(who), pa.array(a.astype(np.int64)), pa.array(s.astype(np.int64)), *(pa.array(x.astype(np.int64)) for x in (start, end, middle))],
                    names=["doc_id", "__h", "anchor", "stretch", "start", "end", "middle"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, __h bigint, anchor bigint, stretch bigint, start bigint, end bigint, middle bigint")


# -- external induced sorting ----------------------------------------------------------------


class ByteQueue:
    """Monotone priority queue of (stretch, common prefix) keyed by a byte.

    Tuples of one byte leave in the order they came, which is that of the suffixes behind the byte.
    While they are pushed, the common prefix of neighbours under the same byte becomes one more than
    the least value between them. Beyond ``most`` tuples the queue goes on in files, one per byte.
    """

    def __init__(self, folder: str, cap: int, most: int):
        self.folder, self.cap, self.most = folder, cap, most
        self.parts: dict[int, list] = {}
        self.files: dict[int, str] = {}
        self.held = 0
        # least common prefix seen since the last tuple of each byte; -1: there was none yet
        self.since = np.full(256, -1, dtype=np.int16)

    def push(self, ids: np.ndarray, common: np.ndarray, byte: np.ndarray, live: np.ndarray) -> None:
        """Add tuples in order. ``common`` refers to the tuple before, also to one that is not live."""
        if not len(ids):
            return
        pick = np.flatnonzero(live)
        order = pick[np.argsort(byte[pick], kind="stable")]
        key = byte[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        value = np.zeros(len(order), dtype=np.int16)
        inner = np.flatnonzero(~first)
        value[inner] = _range_min(common, order[inner - 1] + 1, order[inner]) + 1
        sofar = np.minimum.accumulate(common)
        heads = np.flatnonzero(first)
        known = self.since[key[heads]]
        value[heads] = np.where(known < 0, 0, np.minimum(known, sofar[order[heads]]) + 1)
        # what the next part will need
        onward = np.concatenate([np.minimum.accumulate(common[::-1])[::-1], [np.int16(self.cap)]])
        self.since = np.where(self.since < 0, self.since, np.minimum(self.since, sofar[-1]))
        tails = np.concatenate([heads[1:], [len(order)]]) - 1 if len(heads) else heads
        self.since[key[heads]] = onward[order[tails] + 1]
        value = np.minimum(value, self.cap).astype(np.uint8)
        for b, s, e in zip(key[heads].tolist(), heads.tolist(), (tails + 1).tolist()):
            self.parts.setdefault(b, []).append((ids[order[s:e]].astype(np.int32), value[s:e]))
        self.held += len(order)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        for b, parts in self.parts.items():
            path = self.files.setdefault(b, os.path.join(self.folder, f"queue-{id(self)}-{b}"))
            with open(path, "ab") as f:
                for ids, value in parts:
                    np.rec.fromarrays([ids, value], names="i,v").tofile(f)
        self.parts, self.held = {}, 0

    def drain(self, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples by byte, in parts of about ``step``; the queue is empty afterwards."""
        kind = np.dtype([("i", np.int32), ("v", np.uint8)])
        waiting, size = [], 0
        for b in sorted({*self.files, *self.parts}):
            if b in self.files:
                with open(self.files[b], "rb") as f:
                    while len(got := np.fromfile(f, dtype=kind, count=step)):
                        waiting.append((got["i"], got["v"]))
                        size += len(got)
                        if size >= step:
                            yield _glue(waiting)
                            waiting, size = [], 0
                os.remove(self.files[b])
            for part in self.parts.pop(b, ()):
                waiting.append(part)
                size += len(part[0])
                if size >= step:
                    yield _glue(waiting)
                    waiting, size = [], 0
        if waiting:
            yield _glue(waiting)


def _glue(parts):
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, for many ranges: doubling widths, each range is
    answered by two overlapping pieces of the widest power of two inside it."""
    out = np.zeros(len(low), dtype=np.int16)
    if not len(low):
        return out
    level = np.floor(np.log2(high - low + 1)).astype(np.int64)
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max() + 2))
    mins = values.astype(np.uint8)
    for j in range(len(cuts) - 1):
        if j:
            half = 1 << (j - 1)
            mins = np.minimum(mins[:-half], mins[half:])
        own = order[cuts[j] : cuts[j + 1]]
        if len(own):
            out[own] = np.minimum(mins[low[own]], mins[high[own] - (1 << j) + 1])
    return out


class Columns:
    """Stretches aligned on their anchors: the byte of every stretch at an offset, on demand.

    Held as rows up to ``most`` bytes, then written to disk column by column.
    """

    def __init__(self, folder: str, left: int, right: int, most: int):
        self.folder, self.left, self.width, self.most = folder, left, left + right, most
        self.rows: list[np.ndarray] = []
        self.files: list[tuple[str, int]] = []
        self.n = 0

    def add(self, data: list[bytes], middle: np.ndarray) -> None:
        m = np.zeros((len(data), self.width), dtype=np.uint8)
        for i, (d, p) in enumerate(zip(data, middle.tolist())):
            m[i, self.left - p : self.left - p + len(d)] = np.frombuffer(d, dtype=np.uint8)
        self.rows.append(m)
        self.n += len(data)
        if sum(r.size for r in self.rows) > self.most:
            path = os.path.join(self.folder, f"columns-{len(self.files)}")
            both = np.concatenate(self.rows)
            both.T.tofile(path)
            self.files.append((path, len(both)))
            self.rows = []

    def at(self, offset: int) -> np.ndarray:
        c = offset + self.left
        read = [np.fromfile(path, dtype=np.uint8, count=n, offset=c * n) for path, n in self.files]
        return np.concatenate([*read, *(r[:, c] for r in self.rows), np.zeros(0, np.uint8)])


def repeated_windows(columns: Columns, begin: np.ndarray, end: np.ndarray, length: int, folder: str, most: int = QUEUE_TUPLES) -> list[tuple[int, int, int]]:
    """(stretch, first, last) of the runs of window starts that also occur in another stretch.

    ``begin`` and ``end`` are the offsets of each stretch relative to its anchor.
    """
    step = max(1, min(most, 1 << 20))
    by_end = np.argsort(end, kind="stable")
    ends = end[by_end]
    queue = ByteQueue(folder, length, most)
    out: list[tuple[int, int, int]] = []
    high = np.full(columns.n, np.iinfo(np.int32).max, dtype=np.int32)  # of the open run of each stretch
    low = high.copy()
    for x in range(int(ends[-1]) - 1 if columns.n else -1, int(begin.min(initial=0)) - 1, -1):
        column = columns.at(x)
        fresh = by_end[np.searchsorted(ends, x + 1, "left") : np.searchsorted(ends, x + 1, "right")]
        nxt = ByteQueue(folder, length, most)
        # a stretch that ends here starts as the empty suffix, before all others
        nxt.push(fresh, np.zeros(len(fresh), np.int16), column[fresh], np.ones(len(fresh), bool))
        for ids, common in queue.drain(step):
            nxt.push(ids, common.astype(np.int16), column[ids], begin[ids] <= x)
        queue = nxt
        if x <= 0:
            for who in _equal(queue, length):
                run_goes_on = low[who] == x + 1
                closed = who[~run_goes_on & (low[who] != np.iinfo(np.int32).max)]
                out.extend(zip(closed.tolist(), low[closed].tolist(), high[closed].tolist()))
                new = who[~run_goes_on]
                high[new] = x
                low[who] = x
    open_ = np.flatnonzero(low != np.iinfo(np.int32).max)
    out.extend(zip(open_.tolist(), low[open_].tolist(), high[open_].tolist()))
    return out


def _equal(queue: ByteQueue, length: int) -> Iterator[np.ndarray]:
    """Stretches whose suffix shares ``length`` bytes with a neighbour; leaves the queue as it is."""
    for b in sorted({*queue.files, *queue.parts}):
        before = None
        for ids, value in _parts(queue, b):
            same = value >= length
            hit = same.copy()
            hit[:-1] |= same[1:]
            if before is not None and len(same) and same[0]:
                yield before
            yield ids[hit]
            before = ids[-1:] if len(ids) and not hit[-1] else None


def _parts(queue: ByteQueue, b: int):
    if b in queue.files:
        kind = np.dtype([("i", np.int32), ("v", np.uint8)])
        with open(queue.files[b], "rb") as f:
            while len(got := np.fromfile(f, dtype=kind, count=queue.most)):
                yield got["i"], got["v"]
    yield from queue.parts.get(b, ())


def scratch_root() -> str | None:
    """Spark's own scratch folders, as for spilled shuffles: private to a task and gone after it."""
    return next(iter(os.environ.get("SPARK_LOCAL_DIRS", "").split(",")), "") or None


def _sort_shard(length: int, gram: int, most: int, column_bytes: int):
    def run(batches):
        folder = tempfile.mkdtemp(prefix="suffixes-", dir=scratch_root())
        try:
            columns = Columns(folder, length - gram, length, column_bytes)
            begin, end, single, keys = [], [], [], []
            for batch in batches:
                middle = np.asarray(batch.column("offset"), dtype=np.int64)
                data = batch.column("data").to_pylist()
                columns.add(data, middle)
                begin.append(-middle)
                end.append(np.fromiter(map(len, data), np.int64, len(data)) - middle)
                single.append(np.asarray(batch.column("n"), dtype=np.int64) == 1)
                keys.append(batch.select(["doc_id", "__h", "start"]))
            if not keys:
                return
            begin, single = np.concatenate(begin), np.concatenate(single)
            found = [f for f in repeated_windows(columns, begin, np.concatenate(end), length, folder, most) if single[f[0]]]
            if found:
                who, first, last = (np.array(x, dtype=np.int64) for x in zip(*found))
                own = pa.Table.from_batches(keys).take(pa.array(who)).combine_chunks().to_batches()[0]
                start = np.asarray(own.column("start"), dtype=np.int64) - begin[who]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("__h"), pa.array(start + first), pa.array(start + last + length)], names=["doc_id", "__h", "start", "end"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


# -- the operator ----------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED, queue_tuples: int = QUEUE_TUPLES, column_bytes: int = COLUMN_BYTES) -> DataFrame:
    """(doc_id, __h, start, end) in bytes: ranges that together cover all repeated windows.

    A row that is there several times repeats itself; each copy counts as another place.
    """
    docs = docs.select("doc_id", "text")
    rows = _stretch_rows(docs, length, gram)
    seen = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
    again = stored(seen.where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("alike")))
    # hot anchors sit on one side only, and nothing above the join needs them together
    hits = stored(rows.join(again, "anchor"))
    known = hits.where("alike").select("doc_id", "__h", "start", "end")
    mixed = hits.where(~F.col("alike"))
    kind = hits.schema["doc_id"].dataType.simpleString()
    # of equal stretches any one will do
    place = F.struct("doc_id", "__h", "start", "end", "middle")
    different = stored(mixed.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("n"), F.first(place).alias("p")).select("anchor", "stretch", "n", "p.*"))
    copied = mixed.join(different.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").select("doc_id", "__h", "start", "end")
    many = stored(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowded).select("anchor"))
    wanted = different.groupBy("doc_id", "__h").agg(F.collect_list(F.struct("anchor", "n", "start", "end", "middle")).alias("__w"))
    keyed = docs.withColumn("__k", row_key()[1]).withColumnRenamed("__k", "__h")
    # a row that is there several times is cut once
    often = mixed.groupBy("doc_id", "__h", "start").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = stored(often.select("doc_id", "__h").distinct())
    if not often.isEmpty():
        merged = join_on_key(keyed, often, "left_semi").dropDuplicates(["doc_id", "__h"])
        keyed = join_on_key(keyed, often, "left_anti").unionAll(merged)
    cut = stored(_cut_out(join_on_key(keyed, wanted, "inner"), kind))
    calm = cut.join(many, "anchor", "left_anti").repartition("anchor").select("doc_id", "__h", "start", "offset", "n", "data")
    spans = f"doc_id {kind}, __h bigint, start bigint, end bigint"
    sorted_ = calm.mapInArrow(_sort_shard(length, gram, queue_tuples, column_bytes), spans)
    counted = _crowded(cut.join(many, "anchor", "left_semi"), kind, length)
    out = known.unionAll(copied).unionAll(sorted_)
    return out if many.isEmpty() else out.unionAll(counted)


def _cut_out(text: DataFrame, kind: str) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            keys, cols = [], {c: [] for c in ("anchor", "n", "start", "offset", "data")}
            for i, (t, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__w").to_pylist())):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    keys.append(i)
                    cols["anchor"].append(w["anchor"])
                    cols["n"].append(w["n"])
                    cols["start"].append(w["start"])
                    cols["offset"].append(w["middle"] - w["start"])
                    cols["data"].append(raw[w["start"] : w["end"]])
            who = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(who), batch.column("__h").take(who), *(pa.array(cols[c], pa.int64()) for c in ("anchor", "n", "start", "offset")), pa.array(cols["data"], pa.binary())],
                names=["doc_id", "__h", "anchor", "n", "start", "offset", "data"],
            )

    return text.select("doc_id", "__h", "text", "__w").mapInArrow(run, f"doc_id {kind}, __h bigint, anchor bigint, n bigint, start bigint, offset bigint, data binary")


def _crowded(cut: DataFrame, kind: str, length: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, __h, start, end) of the repeated windows of crowded stretches, counted by hash.

    Windows are taken ``block`` starts at a time. A block that occurs again as a whole is repeated
    throughout. Only blocks of other contents whose common bytes, shared by all their windows, occur
    in several contents are looked at window by window, once per content.
    """
    blocks = cut.mapInArrow(
        _blocks(length, block),
        f"doc_id {kind}, __h bigint, anchor bigint, start bigint, n bigint, j bigint, c1 bigint, c2 bigint, w array<struct<a:bigint,b:bigint>>",
    ).withColumns({"b1": F.xxhash64("w"), "b2": F.xxhash64(F.lit(1), "w")})
    blocks = stored(blocks)
    at = ["anchor", "j", "c1", "c2"]
    contents = stored(blocks.groupBy(*at, "b1", "b2").agg(F.sum("n").alias("m"), F.first("w").alias("w")))
    shared = contents.groupBy(*at).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*at)
    near = stored(contents.join(shared, at, "left_semi"))
    windows = near.select("m", F.explode("w").alias("w")).groupBy("w").agg(F.sum("m").alias("m")).where("m > 1").select("w")
    single = blocks.where("n = 1").select("doc_id", "__h", "start", *at, "b1", "b2", F.size("w").alias("size"))
    key = [*at, "b1", "b2"]
    whole = single.join(contents.where("m > 1").select(*key), key, "left_semi")
    parts = single.join(near.where("m = 1").select(*key, "w"), key).select("doc_id", "__h", "start", F.posexplode("w").alias("i", "w"))
    parts = parts.join(windows, "w", "left_semi")
    return whole.select("doc_id", "__h", "start", (F.col("start") + F.col("size") - 1 + length).alias("end")).unionAll(
        parts.select("doc_id", "__h", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + length).alias("end"))
    )


def _blocks(length: int, block: int):
    """Blocks of window starts, aligned on the anchor: hashes of the bytes that all windows of the
    full block share, and of every window."""

    def run(batches):
        for batch in batches:
            who, cols = [], {c: [] for c in ("start", "j", "c1", "c2", "w")}
            for i, (data, s, offset) in enumerate(zip(batch.column("data").to_pylist(), batch.column("start").to_pylist(), batch.column("offset").to_pylist())):
                raw = np.frombuffer(data, dtype=np.uint8)
                one, two = _sums(raw), _sums(raw ^ np.uint8(0xA5))
                at = np.arange(len(raw) - length + 1)
                j = (at - offset) // block
                first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
                # from the last possible start of the block to the end of its first one
                lo, hi = j[first] * block + block - 1 + offset, j[first] * block + length + offset
                lo = np.minimum(lo, len(raw))
                a, b = _hash(one, at, at + length).astype(np.int64).tolist(), _hash(two, at, at + length).astype(np.int64).tolist()
                ends = [*first[1:].tolist(), len(at)]
                who.extend([i] * len(first))
                cols["start"].extend((s + first).tolist())
                cols["j"].extend(j[first].tolist())
                cols["c1"].extend(_hash(one, lo, hi).astype(np.int64).tolist())
                cols["c2"].extend(_hash(two, lo, hi).astype(np.int64).tolist())
                cols["w"].extend([{"a": x, "b": y} for x, y in zip(a[f:e], b[f:e])] for f, e in zip(first.tolist(), ends))
            take = pa.array(who, pa.int64())
            wide = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("doc_id", "__h", "anchor")] + [pa.array(cols["start"], pa.int64()), batch.column("n").take(take)]
                + [pa.array(cols[c], pa.int64()) for c in ("j", "c1", "c2")] + [pa.array(cols["w"], wide)],
                names=["doc_id", "__h", "anchor", "start", "n", "j", "c1", "c2", "w"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep=None, **settings) -> DataFrame:
    """The kept columns (all by default) plus ``n_bytes``, ``spans`` (removed ranges, array of start
    and end in bytes) and ``kept`` (the remaining bytes, which need not be whole characters).

    Null counts as the empty text. Texts under ``length`` bytes lose nothing. Rows that repeat remove
    each other, like other copies. Columns of the new names are replaced. ``settings`` are those of
    :func:`repeated_spans`.
    """
    docs = docs.drop("n_bytes", "spans", "kept", "__h", "__spans")
    carried = list(docs.columns if keep is None else keep)
    # at most one range for each anchor of one document, however often the row is there
    found = repeated_spans(docs, length, **settings).groupBy("doc_id", "__h").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    joined = join_on_key(docs.withColumn("__h", row_key()[1]), stored(found), "left").drop("__h")

    def cut(batch):
        out = {"n_bytes": [], "spans": [], "kept": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs = []
            for r in sorted((s["start"], s["end"]) for s in spans or ()):
                if runs and r[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], r[1])
                else:
                    runs.append([*r])
            edges = [0, *(x for r in runs for x in r), len(raw)]
            out["n_bytes"].append(len(raw))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])))
        return out

    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (("n_bytes", "bigint"), ("spans", "array<struct<start:bigint,end:bigint>>"), ("kept", "binary"))])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batch):
        new = cut(batch)
        return [pa.array(new[f.name], t) for f, t in zip(added.fields, kinds)]

    return append_columns(joined, carried, {"text": F.col("text"), "__spans": F.col("__spans")}, added, run)


def op3(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    size = lambda s: s["end"] - s["start"]
    return out.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + size(s)).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
