"""Joins of points with intervals as joins by key: intervals fall into dyadic blocks, points name the blocks that hold them.

An inclusive interval of whole numbers is cut into the fewest blocks [i * 2**l, (i + 1) * 2**l - 1], at most two a level; the
blocks of one interval don't overlap. A point lies in one block of each level. So a point and an interval share exactly one
(level, block) if the interval holds the point, and none otherwise: an equi-join yields each pair once, which shuffles and
spills like any other, where a condition on ranges would compare every point with every interval.

Defined results: a null end is open; a null point is in no interval; an interval whose ends are reversed holds nothing; dates
count as days. Open ends are cut to the points' own range, which one small aggregate finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks: numbers below 2**LEVELS are told apart, enough for days of any calendar and for seconds of two centuries.
LEVELS = 33


def _number(value: Column, kind: str) -> Column:
    return F.unix_date(value).cast("long") if kind == "date" else value.cast("long")


def blocks(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The (level, block) pairs that an interval of whole numbers is cut into; none for a reversed one."""
    pairs = []
    for level in range(levels):
        size = 1 << level
        inside = lambda i, s=size: (i * s >= first) & ((i + 1) * s - 1 <= last)
        low, high = F.ceil(first / F.lit(size)).cast("long"), (F.floor((last + 1) / F.lit(size)) - 1).cast("long")
        whole = lambda i, s=size: inside(i) & ~((F.floor(i / 2) * 2 * s >= first) & ((F.floor(i / 2) * 2 + 2) * s - 1 <= last))
        one = lambda i, lv=level: F.struct(F.lit(lv).alias("level"), i.alias("block"))
        pairs += [F.when(whole(low), one(low)), F.when(whole(high) & (high != low), one(high))]
    return F.array_compact(F.array(*pairs))


def ancestors(point: Column, levels: int = LEVELS) -> Column:
    """The (level, block) pairs that hold a whole number."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda lv: F.struct(lv.alias("level"), F.floor(point / F.pow(F.lit(2.0), lv)).cast("long").alias("block")))


def pairs(points: DataFrame, intervals: DataFrame, point: str, first: str, last: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Each row of points beside each row of intervals that holds it (and agrees on the on columns), once.

    Columns of intervals but on follow those of points; names must differ.
    """
    kind = points.schema[point].dataType.typeName()
    span = points.agg(F.min(point).alias("low"), F.max(point).alias("high")).first()
    if span["low"] is None:
        return points.join(intervals, F.lit(False), "inner") if not on else points.join(intervals.filter("false"), list(on))
    bound = lambda c, end: F.coalesce(F.col(c), F.lit(span[end]))
    start, end = _number(F.greatest(bound(first, "low"), F.lit(span["low"])), kind), _number(F.least(bound(last, "high"), F.lit(span["high"])), kind)
    levels = max(1, (int(points.sparkSession.range(1).select((_number(F.lit(span["high"]), kind) - _number(F.lit(span["low"]), kind)).alias("n")).first()["n"]) + 1).bit_length() + 1)
    held = intervals.withColumn("_at", F.explode(blocks(start, end, levels)))
    named = points.filter(F.col(point).isNotNull()).withColumn("_at", F.explode(ancestors(_number(F.col(point), kind), levels)))
    return named.join(held, [*on, "_at"]).drop("_at")


def holding(points: DataFrame, intervals: DataFrame, point: str, first: str, last: str, on: tuple[str, ...] = ()) -> DataFrame:
    """The distinct points (with the on columns) that some interval holds."""
    ends = intervals.select(*on, F.col(first).alias("_first"), F.col(last).alias("_last")).distinct()
    return pairs(points.select(*on, point).distinct(), ends, point, "_first", "_last", on).select(*on, point).distinct()
