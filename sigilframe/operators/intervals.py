"""Joins of points with the intervals that hold them, as equi-joins on buckets.

Intervals have levels by their length: those of a level are at most as long as its buckets, so each lies in one or two
of them. A point looks into its bucket of every level in use, of which there are as many as doublings between the
shortest and the longest interval. No nested loop; a bucket with very many points is a skewed key, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leveled(intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Intervals with __level and __bucket, a row for each bucket. Those that are null or turned hold nothing."""
    there = intervals.filter(F.col(low) <= F.col(high))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)).cast("double") / width))).cast("int")
    sized = there.withColumn("__level", F.coalesce(level, F.lit(0)))
    edge = lambda c: F.floor(F.col(c).cast("double") / (width * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    return sized.withColumn("__bucket", F.explode(F.sequence(edge(low), edge(high))))


def join_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Each point with each interval that holds it, both ends included. Columns of both; their names must differ.

    width: of the least buckets; the shortest interval's that isn't empty, if it isn't given.
    """
    if width is None:
        length = (F.col(high) - F.col(low)).cast("double")
        width = intervals.filter(length > 0).agg(F.min(length)).first()[0] or 1.0
    held = leveled(intervals, low, high, width)
    levels = sorted(r["__level"] for r in held.select("__level").distinct().collect())
    if not levels:
        levels = [0]
    bucket = lambda x: F.floor(F.col(at).cast("double") / (width * 2.0**x)).cast("long")
    looked = F.explode(F.array(*(F.struct(F.lit(x).alias("__level"), bucket(x).alias("__bucket")) for x in levels)))
    seen = points.filter(F.col(at).isNotNull()).withColumn("__look", looked).select("*", "__look.*").drop("__look")
    met = seen.join(held, ["__level", "__bucket"])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__level", "__bucket")


def first_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, low: str, high: str, order: list[Column | str], width: float | None = None) -> DataFrame:
    """Of the intervals that hold a point, the first in order. key: columns that tell points apart."""
    met = join_intervals(points, intervals, at, low, high, width)
    ranked = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order), *(F.col(c) for c in intervals.columns if c not in order))
    best = met.groupBy(*key).agg(F.min(ranked).alias("__best"))
    return points.join(best.select(*key, *(F.col("__best")[c].alias(c) for c in intervals.columns)), key)
