"""Duplicates between and within sources.

Rows have source, origin (a string), area, fine and coarse. Groups are aggregated and joined back, so that copies of
one row, however many, are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fine_groups(rows: DataFrame) -> DataFrame:
    """Per fine hash: its rows, whether sources share it, and the source of the largest area (then the last name)."""
    return rows.groupBy("fine").agg(
        F.count(F.lit(1)).alias("group_n"),
        (F.min("source") != F.max("source")).alias("shared"),
        F.max(F.struct("area", "source"))["source"].alias("winner"),
    )


def drop_cross_source(rows: DataFrame) -> DataFrame:
    """Of a fine hash that sources share, all rows of the winner's source stay."""
    groups = fine_groups(rows).filter("shared").select("fine", "winner")
    joined = rows.join(groups, "fine", "left")
    return joined.filter(F.col("winner").isNull() | (F.col("source") == F.col("winner"))).drop("winner")


def drop_within_source(rows: DataFrame) -> DataFrame:
    """Of a coarse hash in a source, the row of the largest area (then the last origin) stays."""
    best = rows.groupBy("source", "coarse").agg(F.max(F.struct("area", "origin", "fine")).alias("best"), F.count(F.lit(1)).alias("merged"))
    return best.select("source", "best.origin", "best.area", "best.fine", "coarse", "merged")


def deduplicate(rows: DataFrame) -> DataFrame:
    return drop_within_source(drop_cross_source(rows))


def dedup_counters(rows: DataFrame) -> DataFrame:
    """One row: cross_source counts all rows of shared groups but one, kept siblings too; within_source those that the
    second pass merges. Their sum may exceed what was dropped, which `dropped` gives."""
    first = drop_cross_source(rows)
    second = drop_within_source(first)
    cross = fine_groups(rows).filter("shared").agg(F.coalesce(F.sum(F.col("group_n") - 1), F.lit(0)).alias("cross_source"))
    within = second.agg(F.coalesce(F.sum(F.col("merged") - 1), F.lit(0)).alias("within_source"), F.count(F.lit(1)).alias("kept"))
    total = rows.agg(F.count(F.lit(1)).alias("input"))
    # three single rows
    out = total.join(F.broadcast(cross)).join(F.broadcast(within))
    return out.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("input", "cross_source", "within_source", "kept")],
        (F.col("input") - F.col("kept")).cast("bigint").alias("dropped"),
    )
