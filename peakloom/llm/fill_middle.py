"""Fill-in-the-middle: texts are cut into prefix, middle and suffix and put together in another order.

The draws are hashes of the id, worked out by Spark. Cutting runs in pyarrow.compute: the units (code
points) of a batch become list arrays, these are flattened with parent indices, every unit gets its
ordinal and a role, and the units of one role are made lists again and joined into one piece a text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.common import append_columns, table

#: Marks of prefix, suffix and middle; a text that holds one of them stays as it is.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts, those that are transformed, and of 100 of these, those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
# Text whose units are spread out at once; longer texts go through in blocks of it.
BLOCK_BYTES = 1 << 18


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def units(texts: pa.StringArray) -> pa.ListArray:
    """Every text as the list of its code points; they share the bytes of the texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32) + offsets[0]
    bounds = np.searchsorted(starts, offsets).astype(np.int32)
    ends = np.append(starts, offsets[-1]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), data)
    return pa.ListArray.from_arrays(pa.array(bounds), flat)


def cut(lists: pa.ListArray, low: pa.Array, high: pa.Array) -> list[pa.StringArray]:
    """The units before ``low``, from there to ``high`` and from ``high`` on, joined, for every list."""
    parent = pc.list_parent_indices(lists)
    flat = pc.list_flatten(lists)
    first = pc.take(lists.offsets.cast(pa.int64()), parent)
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), first)
    past = [pc.greater_equal(ordinal, pc.take(bound, parent)).cast(pa.int8()) for bound in (low, high)]
    role = pc.add(*past)
    out = []
    for r in range(3):
        mine = pc.equal(role, pa.scalar(r, pa.int8()))
        sizes = np.bincount(pc.filter(parent, mine).to_numpy(), minlength=len(lists))
        out.append(_joined(pc.filter(flat, mine), sizes))
    return out


def _joined(values: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """Consecutive values joined into one string per size."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), "")


def _blocks(texts: pa.StringArray, most: int) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The texts in blocks of whole code points, about ``most`` bytes each: (blocks, text of each,
    number of units of its text before it). An empty text has no block."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(data, np.uint8)
    starts, owner = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while a < b:
            starts.append(a)
            owner.append(i)
            a += most
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
    ends = np.array([*starts, offsets[-1]], dtype=np.int32)
    blocks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), data)
    owner = np.array(owner, dtype=np.int64)
    if not len(owner):
        return blocks, owner, owner
    lead = (raw[offsets[0] : offsets[-1]] & 0xC0) != 0x80
    count = np.add.reduceat(lead, ends[:-1] - offsets[0], dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(count)[:-1]])
    return blocks, owner, before - before[np.searchsorted(owner, owner)]


def pieces_of(texts: pa.StringArray, low: np.ndarray, high: np.ndarray, most: int = BLOCK_BYTES) -> list[pa.StringArray]:
    """Prefix, middle and suffix of every text; ``low`` and ``high`` count units."""
    blocks, owner, before = _blocks(texts, most)
    sizes = np.diff(np.frombuffer(blocks.buffers()[1], np.int32)[: len(blocks) + 1].astype(np.int64))
    reach = np.cumsum(sizes)
    found: list[list] = [[], [], []]
    at = 0
    while at < len(blocks):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, side="right")))
        part = slice(at, stop)
        own = owner[part]
        three = cut(units(blocks[part]), pa.array(low[own] - before[part]), pa.array(high[own] - before[part]))
        for have, more in zip(found, three):
            have.append(more)
        at = stop
    per_text = np.bincount(owner, minlength=len(texts))
    return [_joined(pa.concat_arrays(have) if have else pa.array([], pa.string()), per_text) for have in found]


def assembled(form: pa.StringArray, texts: pa.StringArray, parts: list[pa.StringArray], marks=MARKS) -> pa.StringArray:
    """Output of every text: its pieces behind their marks in the order of its form, or itself."""
    prefix, middle, suffix = parts
    p, s, m = marks
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "psm"), psm, spm))


def restored(form: pa.StringArray, output: pa.StringArray, marks=MARKS) -> pa.StringArray:
    """The texts again, from output and form alone: no piece holds a mark, so the marks cut it."""
    moved = pc.not_equal(form, "plain")
    kind, whole = pc.filter(form, moved), pc.filter(output, moved)
    if not len(whole):
        return output
    parts = pc.split_pattern_regex(whole, "|".join(map(re.escape, marks)))
    one, two, middle = (pc.list_element(parts, i) for i in (1, 2, 3))
    psm = pc.equal(kind, "psm")
    back = pc.binary_join_element_wise(pc.if_else(psm, one, two), middle, pc.if_else(psm, two, one), "")
    return pc.replace_with_mask(output, moved, back)


def transform(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, marks=MARKS) -> DataFrame:
    """All columns of ``docs`` plus n, form, prefix_chars, middle_chars, output and restored.

    Null texts count as empty. Empty texts, texts that hold a mark and those beyond the share to be
    transformed keep form ``plain``: output is the text, the two lengths are null. Rows that share an
    id share its draws; a null id draws as an empty one. Columns of the same names are replaced.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    carried = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    n = F.char_length(text).cast("bigint")
    marked = F.lit(False)
    for m in marks:
        marked = marked | text.contains(m)
    form = (
        F.when((n == 0) | marked | (h3 % 100 >= transformed), F.lit("plain"))
        .when(h4 % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    )
    low, high = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))

    def run(batch):
        texts, form = (batch.column(c).cast(pa.string()) for c in ("__text", "__form"))
        low, high = (batch.column(c).to_numpy() for c in ("__low", "__high"))
        output = assembled(form, texts, pieces_of(texts, low, high), marks)
        plain = pc.equal(form, "plain")
        size = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(x))
        return [batch.column("__n"), form, size(low), size(high - low), output, restored(form, output, marks)]

    kinds = ["bigint", "string", "bigint", "bigint", "string", "string"]
    schema = T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in zip(added, kinds)])
    inputs = {"__text": text, "__n": n, "__form": form, "__low": low, "__high": high}
    return append_columns(docs, carried, inputs, schema, run)


def op13(spark, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256")
    )


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS d
  FROM documents
), numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS c2,
    ('0x' || substr(d, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS r4
  FROM drawn
), formed AS (
  SELECT doc_id, text, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain'
      WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), cut AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1, n - hi) AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
