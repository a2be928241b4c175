"""Joins by time: the last row before, and points within intervals. Keys that hold much are split along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _stretch(time: Column, seconds: int) -> Column:
    """The number of the stretch of time, of so many seconds, that a time lies in."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000.0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], *, left_time: str, right_time: str, order: str, stretch: int = 86_400) -> DataFrame:
    """left with the columns of the last row of right of the same keys whose time is not after its own; of rows of the same time the one of the largest `order`. Null where there is none.

    Both are put on one time line, in one sorted pass for each key and stretch of so many seconds, which takes what came last; what a stretch begins with is the last row of the stretches before it, of which each
    gives one. Columns of right but the keys must differ from those of left. Rows of left with a null key or time have no partner; rows of right with one are none's.
    """
    told = [c for c in right.columns if c not in keys]
    known = right.where(F.col(right_time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    known = known.select(*keys, F.col(right_time).alias("__at"), F.col(order).alias("__order"), F.struct(*told).alias("__told"), _stretch(F.col(right_time), stretch).alias("__stretch"))
    asked = left.select(F.struct(*left.columns).alias("__left"), *keys, F.col(left_time).alias("__at"), _stretch(F.col(left_time), stretch).alias("__stretch"))
    line = asked.withColumn("__side", F.lit(1)).unionByName(known.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    seen = W.partitionBy(*keys, "__stretch").orderBy("__at", "__side", "__order").rowsBetween(W.unboundedPreceding, 0)
    here = line.withColumn("__last", F.last("__told", ignorenulls=True).over(seen)).where("__side = 1")
    ends = known.groupBy(*keys, "__stretch").agg(F.max_by("__told", F.struct("__at", "__order")).alias("__told"))
    # Stretches with a row of right, and those that only ask, in order: what is the last that came before each?
    stretches = asked.select(*keys, "__stretch").distinct().join(ends, [*keys, "__stretch"], "full")
    before = stretches.withColumn("__before", F.last("__told", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1))).select(*keys, "__stretch", "__before")
    out = here.join(before, [*keys, "__stretch"], "left")
    return out.select("__left.*", *[F.coalesce("__last", "__before")[c].alias(c) for c in told])


def within(intervals: DataFrame, points: DataFrame, key: str, *, start: str, end: str, time: str, stretch: int = 3_600) -> DataFrame:
    """Rows of intervals with those of points of the same key whose time lies in [start, end].

    An interval is named in every stretch of time that it touches, a point in its own, and they meet by key and stretch: each pair once, and no key's rows all in one place. stretch, in seconds, should be about the
    length of an interval. Columns but the key must differ. A null key, bound or time meets nothing; an interval that ends before it starts is empty.
    """
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("__stretch", F.explode(F.sequence(_stretch(F.col(start), stretch), _stretch(F.col(end), stretch))))
    placed = points.withColumn("__stretch", _stretch(F.col(time), stretch))
    return spread.join(placed, [key, "__stretch"]).where(F.col(time).between(F.col(start), F.col(end))).drop("__stretch")
