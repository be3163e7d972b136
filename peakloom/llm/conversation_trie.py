"""Prefix trie of conversations, from adaptive radix trees over turn ids.

Every turn has an id of fixed width (16 bytes, big-endian, of the hash of role and text), a
conversation is the concatenation of its ids. Distinct conversations are sorted over the cluster; each
task puts its range into an adaptive radix tree and emits one row for every turn-aligned depth of it.

All that a node reports is a sum or a minimum over its members once each node is counted in one range
only: the first one that has it. Which nodes an earlier range has is told by the path of the last key
before the range, so a node with any number of members is put together from one row a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import table
from peakloom.plans.durable import discard, stored

#: Bytes of a turn id.
WIDTH = 16
#: Turns at the beginning taken from the head of the hundred.
MOST_SHARED = 5
#: Keys and lengths held by one tree at most (bytes, about); what a range has beyond goes into the next tree.
TREE_BYTES = 8 << 20
#: Ids written into one piece of a list of members (bytes, about).
PIECE_BYTES = 1 << 20
ROOT = bytes(WIDTH)
_ROWS = 4_096


# -- adaptive radix tree ----------------------------------------------------------------------


class Node:
    """``path`` is the compressed part of the key in front of the node. Children are found by the
    next byte in one of four layouts: up to 4 and up to 16 have sorted labels beside the children,
    up to 48 a table of 256 slots into the children, more than that 256 children."""

    __slots__ = ("path", "end", "size", "labels", "kids", "sample")

    def __init__(self, path: bytes, end: int, sample: int):
        self.path, self.end, self.sample = path, end, sample
        self.size, self.labels, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> "Node | None":
        if self.size <= 16:
            at = self.labels.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            slot = self.labels[byte]
            return self.kids[slot - 1] if slot else None
        return self.kids[byte]

    def put(self, byte: int, node: "Node") -> None:
        """Add a child or replace the one of that byte; the layout grows when it is full."""
        if self.size <= 16:
            at = self.labels.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) < self.size:
                at = sum(label < byte for label in self.labels)
                self.labels.insert(at, byte)
                self.kids.insert(at, node)
                return
            self._grow()
            self.put(byte, node)
        elif self.size == 48:
            slot = self.labels[byte]
            if slot:
                self.kids[slot - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.labels[byte] = len(self.kids)
            else:
                self._grow()
                self.kids[byte] = node
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            slots = bytearray(256)
            for i, label in enumerate(self.labels):
                slots[label] = i + 1
            self.size, self.labels = 48, slots
        else:
            kids = [self.kids[slot - 1] if slot else None for slot in self.labels]
            self.size, self.labels, self.kids = 256, bytearray(), kids

    def children(self) -> list[tuple[int, "Node"]]:
        """(byte, child) in order."""
        if self.size <= 16:
            return list(zip(self.labels, self.kids))
        if self.size == 48:
            return [(b, self.kids[s - 1]) for b, s in enumerate(self.labels) if s]
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


class RadixTree:
    def __init__(self):
        self.root = Node(b"", -1, -1)

    def insert(self, key: bytes, value: int) -> None:
        """Put ``value`` (0 or more) at ``key``; a value put there before is replaced."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.end = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value, value))
                return
            path, start = below.path, at + 1
            if key.startswith(path, start):
                node, at = below, start + len(path)
                continue
            same = _common(path, key, start)
            fork = Node(path[:same], -1, below.sample)
            fork.put(path[same], below)
            below.path = path[same + 1 :]
            node.put(key[at], fork)
            node, at = fork, start + same


def _common(path: bytes, key: bytes, start: int) -> int:
    """Length of the common part of ``path`` and ``key[start:]``, which differ or end."""
    low, high = 0, min(len(path), len(key) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if path[:mid] == key[start : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def digest(parent: bytes, turn: bytes) -> bytes:
    """Name of the node reached from ``parent`` by ``turn``."""
    return hashlib.blake2b(parent + turn, digest_size=WIDTH).digest()


def path_names(key: bytes) -> list[bytes]:
    """Names of the nodes on the path of ``key``, the root first."""
    names = [ROOT]
    for at in range(0, len(key), WIDTH):
        names.append(digest(names[-1], key[at : at + WIDTH]))
    return names


def node_rows(keys: list[bytes], sizes: list[list[int]], counts: list[int], least: list[int], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Rows of one range of sorted distinct keys; ``before`` and ``after`` are its neighbours.

    A row is (name, parent, depth, conversations, least id, children, childless, saved, ends): the part
    of the node that this range adds, and the key's digest where a key ends. ``sizes`` are code points
    per turn. Children, childless nodes and texts are counted only where no earlier range has them.
    """
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    if tree.root.end < 0:
        tree.root.end = -1
    tree.root.sample = 0
    reach = [np.concatenate([[0], np.cumsum(np.asarray(s, dtype=np.int64))]).tolist() for s in sizes]
    seen = set(path_names(before)) if before is not None else set()
    # frames: [node, byte depth of its end, names of the aligned depths on its edge, first of these depths, sums]
    # sums: conversations, least id, characters of all turns of members, childless, open children, text of own nodes
    stack = [[tree.root, 0, [ROOT], 0, None, iter(tree.root.children()), [0, None, 0, 0, 0, 0]]]
    while stack:
        node, at, names, first, above, kids, sums = stack[-1]
        below = next(kids, None)
        if below is not None:
            byte, child = below
            end = at + 1 + len(child.path)
            key = keys[child.sample]
            top = at // WIDTH + 1
            parent = names[-1] if names else above
            own = []
            for d in range(top, end // WIDTH + 1):
                own.append(digest(own[-1] if own else parent, key[(d - 1) * WIDTH : d * WIDTH]))
            stack.append([child, end, own, top, parent, iter(child.children()), [0, None, 0, 0, 0, 0]])
            continue
        stack.pop()
        if node.end >= 0:
            i = node.end
            sums[0] += counts[i]
            sums[1] = least[i] if sums[1] is None else min(sums[1], least[i])
            sums[2] += counts[i] * reach[i][-1]
            extended = after is not None and i == len(keys) - 1 and after.startswith(keys[i])
            childless = node.size == 4 and not node.kids and not extended
            sums[3] += childless
        run = reach[node.sample]
        for j in range(len(names) - 1, -1, -1):
            d = first + j
            new = names[j] not in seen
            if d and new:
                sums[5] += run[d] - run[d - 1]
            saved = sums[2] - sums[0] * (run[d - 1] if d else 0) - sums[5]
            ends = node.end if node.end >= 0 and d * WIDTH == at else -1
            yield names[j], (names[j - 1] if j else above), d, sums[0], sums[1], sums[4], sums[3], saved, ends
            sums[4] = int(new)
        if stack:
            total = stack[-1][6]
            total[0] += sums[0]
            total[1] = sums[1] if total[1] is None else min(total[1], sums[1])
            for k in (2, 3, 4, 5):
                total[k] += sums[k]


# -- conversations as keys --------------------------------------------------------------------


def _binary16(value: Column) -> Column:
    """First 16 bytes of the SHA-256 of a value."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * WIDTH))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, as structs of id and code points.

    Order is by turn, null first; turns that share a number are ordered by role, then by the hash of
    role and text, so equal rows stay side by side. Null role and text are empty; rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.struct(F.col("turn"), role.alias("role"), _binary16(whole).alias("id"), F.char_length(text).alias("size"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): each conversation behind the first turns of the head of its hundred.

    The head of c is c - c % 100, the number of turns crc32(decimal c) % 6. A head has 99 others at
    most, so the join can't grow.
    """
    head = turns.where(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, MOST_SHARED).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    none = F.array().cast(turns.schema["turns"].dataType)
    joined = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % 100).join(head, "head", "left")
    whole = joined.select("conv_id", F.concat(F.slice(F.coalesce("shared", none), F.lit(1), h), own).alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["id"])), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def _flushed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_NODES = "name binary, parent binary, depth bigint, n bigint, least bigint, children bigint, leaves bigint, saved bigint, ends binary"
_NODE_SCHEMA = pa.schema([
    ("name", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "n", "least", "children", "leaves", "saved")], ("ends", pa.binary()),
])


def _trees(most: int):
    """Rows (part, mark, key, sizes, n, least, digest), sorted by part, mark and key, to node rows.

    The first row of a part (mark 0) carries its neighbours: the last key before it as ``key``, the
    first one after it as ``digest``."""

    def entries(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches):
        out: list[tuple] = []
        held: list[tuple] = []
        part = before = last = None
        weight = 0

        def tree(after):
            keys = [e[2] for e in held]
            for row in node_rows(keys, [e[3] for e in held], [e[4] for e in held], [e[5] for e in held], before, after):
                yield (*row[:8], held[row[8]][6] if row[8] >= 0 else None)

        def emit(after):
            for row in tree(after):
                out.append(row)
                if len(out) >= _ROWS:
                    yield _flushed(out, _NODE_SCHEMA)
                    out.clear()

        for entry in entries(batches):
            if entry[0] != part:
                if held:
                    yield from emit(last)
                held, weight = [], 0
                part, before, last = entry[0], entry[2], entry[6]
                continue
            if weight >= most:
                yield from emit(entry[2])
                before, held, weight = held[-1][2], [], 0
            held.append(entry)
            weight += len(entry[2]) + 8 * len(entry[3]) + 64
        if held:
            yield from emit(last)
        if out:
            yield _flushed(out, _NODE_SCHEMA)

    return run


def _member_pieces(batches):
    """Sorted (digest, conv_id) to (digest, first id, ids joined by commas), a piece at a time."""
    schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    now, first, ids, size, out = None, None, [], 0, []
    for batch in batches:
        for key, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now or size >= PIECE_BYTES:
                if ids:
                    out.append((now, first, ",".join(ids).encode()))
                    if size >= PIECE_BYTES or len(out) >= _ROWS:
                        yield _flushed(out, schema)
                        out = []
                now, first, ids, size = key, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        out.append((now, first, ",".join(ids).encode()))
    if out:
        yield _flushed(out, schema)


def _hashed_members(batches):
    """Sorted (digest, first id, ids) to (digest, SHA-256 of all ids joined); one piece at a time."""
    schema = pa.schema([("ends", pa.binary()), ("ends_sha256", pa.string())])
    now, state, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
            if len(out) >= _ROWS:
                yield _flushed(out, schema)
                out = []
    if state is not None:
        out.append((now, state.hexdigest()))
    if out:
        yield _flushed(out, schema)


def member_hashes(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) of (digest, conv_id): the ids of each digest in order, hashed.

    A hash of one long list has to be fed in order; ids are joined where they are sorted, in ranges
    over the cluster, and one task reads the pieces of a list, never more than one at a time."""
    ranges = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = ranges.mapInArrow(_member_pieces, "digest binary, first bigint, ids binary")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed_members, "ends binary, ends_sha256 string")


def build(conversations: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, see :func:`op12`.

    Without conversations there is no node, not even the root. A conversation is one key: 16 bytes a
    turn have to fit a row. Columns other than conv_id, turn, role and text are not read.
    """
    turns = stored(sequences(conversations))
    whole = stored(rebuilt(turns).withColumn("digest", _binary16(F.col("key"))))
    distinct = whole.groupBy("key").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("digest").alias("digest"))
    keys = stored(distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    # one row per range of keys: its neighbours
    bounds = keys.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("part")
    marks = bounds.select(
        "part", F.lit(0).alias("mark"), F.lag("high").over(order).alias("key"), F.lit(None).cast("array<int>").alias("sizes"),
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("least"), F.lead("low").over(order).alias("digest"),
    )
    rows = keys.select("part", F.lit(1).alias("mark"), "key", "sizes", "n", "least", "digest").unionByName(marks)
    parts = rows.repartition("part").sortWithinPartitions("part", "mark", "key")
    nodes = parts.mapInArrow(_trees(tree_bytes), _NODES)
    merged = stored(nodes.groupBy("name").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.first("ends", ignorenulls=True).alias("ends"),
    ))
    discard(turns, keys)
    ended = member_hashes(whole.select("digest", "conv_id"))
    parents = merged.where(F.col("n_children") > 0).select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = merged.join(ended, "ends", "left").join(parents, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return build(table(spark, sf_dir, "conversations"))
