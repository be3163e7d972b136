"""Ordered computations that stay distributed however large one key is.

``Window.partitionBy(key).orderBy(x)`` sends a whole key to one task. That is used while keys are
small. Otherwise rows are range partitioned on (keys, order), each range becomes a chunk, only one
total per (key, chunk) is ordered centrally, and the running value inside a chunk starts from that
offset.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.plans.durable import settled, stored
from peakloom.plans.joins import grown_join, lookup_join, planned_bytes

# A table beyond this size may hold a key that is too large to be ordered by a single task.
TASK_BYTES = 128 << 20
# In such a table, the rows of a key that a single task still orders.
TASK_ROWS = 1 << 20


def sized(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(table, whether it may exceed ``limit`` bytes). Only chooses between two equal plans. A table
    that is not known to be small is written first, which tells its size and is read instead."""
    if planned_bytes(df) <= limit:
        return df, False
    if limit > 0:
        df = stored(df)
    return df, planned_bytes(df) > limit


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    totals: bool = False,
    task_bytes: int | None = None,
) -> DataFrame:
    """Running values per key in ``order``, both ends inclusive.

    ``sums``: output to input column, the sum so far; with ``totals`` also ``<output>_total``, the
    sum over the whole key.
    ``last``: output to input column, the largest value so far. ``following``: the smallest value
    from here on. Rows should be unique on (keys, order), pre-aggregated if necessary, so that the
    order is total and repeated values do not pile up in one range.
    """
    keys, order = list(keys), list(order)
    sums, last, following = dict(sums or {}), dict(last or {}), dict(following or {})
    limit = TASK_BYTES if task_bytes is None else task_bytes
    df, large = sized(df, limit)
    if not large:
        return _windowed_scan(df, keys, order, sums, last, following, totals)
    if not keys or limit <= 0:
        return _chunked_scan(df, keys, order, sums, last, following)
    # a large table of small keys is dealt by key; only keys with many rows, few by their number, are cut
    hot = settled(lambda: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TASK_ROWS).select(*keys))
    if hot.isEmpty():
        return _windowed_scan(df, keys, order, sums, last, following, totals)
    if df.select(*keys).join(F.broadcast(hot), keys, "left_anti").isEmpty():
        return _chunked_scan(df, keys, order, sums, last, following)
    small = _windowed_scan(lookup_join(df, hot, keys, "left_anti"), keys, order, sums, last, following, totals)
    return small.unionByName(_chunked_scan(lookup_join(df, hot, keys, "left_semi"), keys, order, sums, last, following).select(*small.columns))


def _windowed_scan(df, keys, order, sums, last, following, totals) -> DataFrame:
    """The result where a task orders every key as a whole."""
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = _onward(keys, order)
    values = {out: F.sum(src).over(so_far) for out, src in sums.items()}
    if totals:
        values |= {f"{out}_total": F.sum(src).over(Window.partitionBy(*keys)) for out, src in sums.items()}
    values |= {out: F.max(src).over(so_far) for out, src in last.items()}
    values |= {out: F.min(src).over(onward) for out, src in following.items()}
    return df.withColumns(values)


def _onward(keys, order):
    """Rows from the current one on, as those before it in reverse: Spark goes through a frame that ends
    at the last row anew for every row."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _chunked_scan(df, keys, order, sums, last, following) -> DataFrame:
    """The same result for keys of any size."""
    chunked = stored(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn(
            "_chunk", F.spark_partition_id()
        )
    )
    per_chunk = chunked.groupBy(*keys, "_chunk").agg(
        *[F.sum(src).alias(f"_{out}_part") for out, src in sums.items()],
        *[F.max(src).alias(f"_{out}_part") for out, src in last.items()],
        *[F.min(src).alias(f"_{out}_part") for out, src in following.items()],
    )
    # one row per (key, chunk): a hot key contributes at most one row per range
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    part = lambda out: F.col(f"_{out}_part")
    offsets = per_chunk.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(part(o)).over(before), F.lit(0)).alias(f"_{o}_off") for o in sums],
        *[F.sum(part(o)).over(whole).alias(f"{o}_total") for o in sums],
        *[F.max(part(o)).over(before).alias(f"_{o}_off") for o in last],
        *[F.min(part(o)).over(after).alias(f"_{o}_off") for o in following],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = _onward([*keys, "_chunk"], order)
    off = lambda out: F.col(f"_{out}_off")
    joined = grown_join(chunked, offsets, [*keys, "_chunk"])
    values = {out: F.sum(src).over(so_far) + off(out) for out, src in sums.items()}
    # greatest and least skip nulls
    values |= {out: F.greatest(F.max(src).over(so_far), off(out)) for out, src in last.items()}
    values |= {out: F.least(F.min(src).over(onward), off(out)) for out, src in following.items()}
    return joined.withColumns(values).drop("_chunk", *[f"_{o}_off" for o in values])


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums per key and, as ``<output>_total``, the sums over the whole key."""
    return ordered_scan(df, keys, order, sums=sums, totals=True)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles per key; ``percentiles`` maps output name to fraction."""
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    ranked = running_totals(counts, keys, [value], {"_cum": "_n"})
    aggs: list[Column] = []
    for name, p in percentiles.items():
        pos = F.lit(float(p)) * (F.col("_cum_total") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_cum") - F.col("_n") <= at) & (at < F.col("_cum"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
            ).alias(name)
            for name in percentiles
        ],
    )


def dense_codes(df: DataFrame, column: str, code: str, start: int = 0) -> DataFrame:
    """(column, code): consecutive codes over the sorted distinct non-null values."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(distinct, [], [column], {"_rank": "_one"})
    return ranked.select(column, (F.col("_rank") - 1 + start).cast("long").alias(code))


# -- windows of values -----------------------------------------------------------------------
#
# A strict window |x - origin| < w holds a contiguous run of values, so it can be answered from
# two positions in the order of x. The comparison is made on a rounded difference; where exactly
# it flips is worked out with error-free sums, so that the answer equals the comparison itself.

_BELOW, _POINT, _ABOVE = 1, 2, 3


def _exact_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """Rounded sum of two doubles and its rounding error."""
    s = a + b
    back = s - a
    return s, (a - (s - back)) + (b - back)


def _bounds(origin: Column, w: float) -> tuple[Column, Column, Column, Column]:
    """(low, kind of low, high, kind of high): kinds order a probe before or after equal values.

    The rounded difference stays below w until the true one reaches the midpoint between w and
    its lower neighbour; a tie goes to the even one of the two.
    """
    half_step = (w - math.nextafter(w, 0.0)) / 2.0
    tie_inside = bool(struct.unpack("<q", struct.pack("<d", w))[0] & 1)
    ends = []
    for sign in (-1.0, 1.0):
        s, e = _exact_sum(origin, F.lit(sign * w))
        bound, rest = _exact_sum(s, e - F.lit(sign * half_step))
        # on the low side the window starts above bound + rest, on the high side it ends below
        equal_inside = (F.lit(sign) * rest > 0.0) | ((rest == 0.0) & F.lit(tie_inside))
        inside_kind, outside_kind = (_BELOW, _ABOVE) if sign < 0 else (_ABOVE, _BELOW)
        ends += [bound, F.when(equal_inside, inside_kind).otherwise(outside_kind)]
    return tuple(ends)


def window_ranges(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], axis: str, half_width: float,
    point_id: Sequence[str], probe_id: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Number the points of every key along ``axis``; give every probe its half-open range.

    Points get ``_pos`` (0, 1, ...) and ``_size``, the number of points of their key, probes get ``_lo`` and ``_hi`` such that the points inside
    the strict window are those with ``_lo <= _pos < _hi``. The id columns identify a row within
    its key; all columns travel with their row, so nothing is joined back.
    """
    keys, w = list(keys), float(half_width)
    low, low_kind, high, high_kind = _bounds(F.col(axis), w)
    carry = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in keys])
    side = lambda at, kind, name: F.struct(at.alias("at"), kind.alias("kind"), F.lit(name).alias("side"))
    # the columns of a probe travel with its lower end only
    stops = probes.select(
        *keys, F.struct(*probe_id).alias("_probe"), carry(probes).alias("_ask"),
        F.explode(F.array(side(low, low_kind, "lo"), side(high, high_kind, "hi"))).alias("_s"),
    ).select(*keys, "_probe", F.when(F.col("_s.side") == "lo", F.col("_ask")).alias("_ask"), F.col("_s.at").alias("_at"), F.col("_s.kind").alias("_kind"), F.col("_s.side").alias("_side"), F.lit(0).cast("long").alias("_one"))
    marks = points.select(
        *keys, F.struct(*point_id).alias("_point"), carry(points).alias("_row"), F.col(axis).alias("_at"),
        F.lit(_POINT).alias("_kind"), F.lit(1).cast("long").alias("_one"),
    )
    both = marks.unionByName(stops, allowMissingColumns=True)
    ranked = ordered_scan(both, keys, ["_at", "_kind", "_point", "_probe", "_side"], sums={"_cum": "_one"}, totals=True)
    point = F.col("_kind") == _POINT
    # a row per point and one per probe. Both results are read from one evaluation, so equal positions
    # cannot be numbered twice; where a task has whole keys, nothing is moved for it
    once = stored(
        ranked.groupBy(*keys, F.when(point, F.col("_cum")).alias("_at"), "_probe").agg(
            F.max(F.when(F.col("_side") == "lo", F.col("_cum"))).alias("_lo"),
            F.max(F.when(F.col("_side") == "hi", F.col("_cum"))).alias("_hi"),
            F.any_value("_row", True).alias("_row"), F.any_value("_ask", True).alias("_ask"),
            F.max("_cum_total").alias("_size"),
        )
    )
    placed = once.where("_at IS NOT NULL").select(*keys, "_row.*", (F.col("_at") - 1).alias("_pos"), "_size")
    return placed, once.where("_at IS NULL").select(*keys, "_ask.*", "_lo", "_hi")


def range_blocks(points: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Break every range into aligned blocks of 2^level positions and place points in their blocks.

    A range of m positions needs at most 2 log2(m) blocks, so points and probes meet in blocks
    instead of pairwise. Adds ``_level`` and ``_block``.
    """
    probes = stored(probes.where("_hi > _lo"))
    widest = probes.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    levels = int(widest).bit_length()
    # first and last whole block of a range on one level; an odd first or an even last block is
    # not covered by the next level and becomes a piece
    first = "shiftright(_lo + shiftleft(1L, l) - 1, l)"
    end = "shiftright(_hi, l)"
    piece = lambda test, block: f"IF({test} % 2 = 1 AND {first} < {end}, named_struct('level', l, 'block', {block}), NULL)"
    pieces = (
        f"flatten(transform(sequence(0, {levels}), l -> filter(array({piece(first, first)}, "
        f"{piece(end, end + ' - 1')}), b -> b IS NOT NULL)))"
    )
    spread = lambda df, sql: df.withColumn("_b", F.explode(F.expr(sql))).select(
        "*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")
    ).drop("_b")
    # no range of a key is longer than its points
    top = f"least({levels}, length(bin(_size)) - 1)" if "_size" in points.columns else levels
    levels_of_point = f"transform(sequence(0, {top}), l -> named_struct('level', l, 'block', shiftright(_pos, l)))"
    return spread(points, levels_of_point), spread(probes, pieces)


def counts_within(
    df: DataFrame, keys: Sequence[str], value: str, half_width: float, out: str
) -> DataFrame:
    """(keys, value, out): rows of the same key with ``abs(other - value) < half_width``.

    No pairs are formed: every distinct value probes the running count at both ends of its
    window, and probes and values share one ordered pass.
    """
    keys = list(keys)
    points = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    points = stored(points)
    marks = points.select(*keys, F.col(value).alias("_at"), F.col(value).alias("_i0"), "_n")
    return _signed_counts(points, marks, keys, value, float(half_width), [value], out)


def _signed_counts(probes, marks, keys, axis, w, identity, out):
    """Running count at the upper end of each probe's window minus that at the lower end."""
    low, low_kind, high, high_kind = _bounds(F.col(axis), w)
    stop = lambda at, kind, sign: F.struct(at.alias("at"), kind.alias("kind"), F.lit(sign).alias("sign"))
    names = [f"_i{i}" for i in range(len(identity))]
    stops = probes.select(
        *keys, *[F.col(c).alias(n) for c, n in zip(identity, names)],
        F.explode(F.array(stop(low, low_kind, -1), stop(high, high_kind, 1))).alias("_s"),
    ).select(
        *keys, *names, F.col("_s.at").alias("_at"), F.col("_s.kind").alias("_kind"), F.col("_s.sign").alias("_sign"),
        F.lit(0).cast("long").alias("_n"),
    )
    # the identity of a point only splits long runs of equal values between ranges
    marks = marks.select(*keys, "_at", F.lit(_POINT).alias("_kind"), *names, "_n")
    both = stops.unionByName(marks, allowMissingColumns=True)
    ranked = ordered_scan(both, keys, ["_at", "_kind", *names], sums={"_cum": "_n"})
    final = [k for k in keys if k not in ("_level", "_block")]
    return (
        ranked.where(F.col("_sign").isNotNull())
        .groupBy(*final, *[F.col(n).alias(c) for c, n in zip(identity, names)])
        .agg(F.sum(F.col("_sign") * F.col("_cum")).cast("long").alias(out))
    )


def counts_within_box(
    df: DataFrame, keys: Sequence[str], first: str, first_width: float, second: str, second_width: float, out: str
) -> DataFrame:
    """(keys, first, second, out): rows of the same key inside both strict windows.

    The first window becomes a range of positions, the range a few aligned blocks, and inside a
    block the second window is a difference of running counts. Work grows with n log n, not with
    the number of neighbours.
    """
    keys = list(keys)
    points = stored(
        df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(*keys, first, second).agg(F.count(F.lit(1)).alias("_n"))
    )
    own = [first, second]
    placed, ranged = range_blocks(*window_ranges(points, points, keys, first, first_width, own, own))
    block = [*keys, "_level", "_block"]
    marks = placed.select(*block, F.col(second).alias("_at"), F.col(first).alias("_i0"), F.col(second).alias("_i1"), "_n")
    return _signed_counts(ranged, marks, block, second, float(second_width), [first, second], out)


def counts_of_probes(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], window_axis: str, window_width: float,
    axis: str, axis_width: float, point_id: str, probe_id: str, weight: str, out: str,
) -> DataFrame:
    """(keys, probe id, out): sum of the integer ``weight`` of the points inside both strict windows
    around every probe. Probes with no point in the first window are absent."""
    keys = list(keys)
    placed, ranged = range_blocks(*window_ranges(points, probes, keys, window_axis, window_width, [point_id], [probe_id]))
    block = [*keys, "_level", "_block"]
    none = F.lit(None).cast(probes.schema[probe_id].dataType)
    marks = placed.select(*block, F.col(axis).alias("_at"), none.alias("_i0"), F.col(weight).alias("_n"))
    return _signed_counts(ranged, marks, block, axis, float(axis_width), [probe_id], out)


def nearest_within_box(
    points: DataFrame, probes: DataFrame, keys: Sequence[str], window_axis: str, window_width: float,
    axis: str, axis_width: float, point_id: str, probe_id: str, payload: Sequence[str],
) -> DataFrame:
    """For every probe the point closest along ``axis`` among those inside both strict windows.

    Ties go to the smallest ``point_id``. Returns the probe id, ``distance`` and the payload of
    the point; probes without a point are absent. Per block only the neighbours below and above
    the probe are looked at.
    """
    keys = list(keys)
    placed, ranged = range_blocks(
        *window_ranges(points, probes, keys, window_axis, window_width, [point_id], [probe_id])
    )
    block = [*keys, "_level", "_block"]
    body = F.struct(*[F.col(c).alias(c) for c in payload])
    marks = placed.select(
        *block, F.col(axis).alias("_at"), F.lit(None).cast(probes.schema[probe_id].dataType).alias("_probe"),
        # largest-so-far must prefer the smallest id among equal positions, hence the negated id
        F.struct(F.col(axis).alias("at"), (-F.col(point_id)).alias("neg"), body.alias("body")).alias("_down"),
        F.struct(F.col(axis).alias("at"), F.col(point_id).alias("id"), body.alias("body")).alias("_up"),
    )
    asks = ranged.select(*block, F.col(axis).alias("_at"), F.col(probe_id).alias("_probe"))
    both = marks.unionByName(asks, allowMissingColumns=True).withColumn(
        "_order", F.when(F.col("_probe").isNull(), 0).otherwise(1)
    )
    # points equal to the probe come first, so they are found from below
    scanned = ordered_scan(
        both, block, ["_at", "_order", "_probe"], last={"_below": "_down"}, following={"_above": "_up"}
    ).where(F.col("_probe").isNotNull())
    side = lambda c, ident: F.struct(
        F.abs(F.col(f"{c}.at") - F.col("_at")).alias("distance"), ident.alias("id"), F.col(f"{c}.body").alias("body")
    )
    near = F.filter(
        F.array(side("_below", -F.col("_below.neg")), side("_above", F.col("_above.id"))),
        lambda o: o["distance"] < F.lit(float(axis_width)),
    )
    options = scanned.select("_probe", F.array_min(near).alias("_o")).where("_o IS NOT NULL")
    best = options.groupBy(F.col("_probe").alias(probe_id)).agg(F.min("_o").alias("_o"))
    return best.select(probe_id, F.col("_o.distance").alias("distance"), F.col("_o.id").alias(point_id), *[F.col(f"_o.body.{c}").alias(c) for c in payload])
