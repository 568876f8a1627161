"""Blobs of masks as tables: cells to runs, touching runs to edges, edges to components.

Cells are rows, so a mask needn't fit into a task; a line of it is sorted by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linkage import connected_components


def mask_runs(cells: DataFrame) -> DataFrame:
    """Of held cells (mask, y, x), the runs of neighbours on a line: mask, y, first, end (one past the last). A cell that
    is there twice counts once."""
    line = Window.partitionBy("mask", "y").orderBy("x")
    held = cells.select("mask", "y", "x").distinct()
    # within a run x grows as fast as the number of the cell
    island = held.withColumn("__island", F.col("x") - F.row_number().over(line))
    return island.groupBy("mask", "y", "__island").agg(F.min("x").alias("first"), (F.max("x") + 1).alias("end")).drop("__island")


def run_edges(runs: DataFrame) -> DataFrame:
    """Runs of two lines, one below the other, that touch at a side or a corner: source_a, source_b."""
    below = runs.select("mask", (F.col("y") - 1).alias("y"), F.col("first").alias("__first"), F.col("end").alias("__end"), F.col("run").alias("source_b"))
    met = runs.join(below, ["mask", "y"]).filter((F.col("__first") <= F.col("end")) & (F.col("__end") >= F.col("first")))
    return met.select(F.col("run").alias("source_a"), "source_b")


def largest_blobs(cells: DataFrame, least: int = 64) -> DataFrame:
    """Per mask with `least` held cells: left, top, right, bottom and cells of its largest blob; of equal ones that which
    begins first, line by line."""
    runs = mask_runs(cells).withColumn("run", F.concat_ws(":", "mask", "y", "first"))
    groups = connected_components(runs.select(F.col("run").alias("source")), run_edges(runs))
    joined = runs.join(groups.withColumnRenamed("source", "run"), "run")
    blobs = joined.groupBy("mask", "group_id").agg(
        F.sum(F.col("end") - F.col("first")).alias("cells"),
        F.min(F.struct("y", "first")).alias("begin"),
        F.min("first").alias("left"),
        F.min("y").alias("top"),
        F.max("end").alias("right"),
        (F.max("y") + 1).alias("bottom"),
    )
    best = F.max_by(F.struct("left", "top", "right", "bottom", "cells"), F.struct("cells", (-F.col("begin.y")).alias("up"), (-F.col("begin.first")).alias("before")))
    return blobs.groupBy("mask").agg(best.alias("b"), F.sum("cells").alias("held")).filter(F.col("held") >= least).select("mask", "b.*")
