"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Lets the Python workers import this package where they see the driver's folders."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder in spark.checkpoint.dir. Where none is named, one of this machine will do in local mode, as
    in tests; elsewhere the others couldn't read it. Old checkpoints go with spark.cleaner.referenceTracking.cleanCheckpoints."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file:///tmp/checkpoints/sigilframe")


def ordered_index(df: DataFrame, *order: Column | str, out: str = "index") -> DataFrame:
    """Numbers rows from 0 in a total order without bringing them into one task.

    Rows are dealt out by range and sorted in their partitions; a row's number is its place there after the counts of
    the partitions before, of which there are as many as partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = placed.checkpoint()  # range bounds are sampled, so they must be drawn once
    part = F.shiftrightunsigned("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__id").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, place + F.col("__before"))
        .drop("__id", "__part", "__before")
    )


def running_sum(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of value up to each row, in the order of a column, within groups of any size; equal places in the
    order are summed together.

    Rows are dealt out by range of group and place, and what lies in the ranges before is added.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()).checkpoint()
    totals = placed.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order))
    joined = placed.withColumn("__inside", inside).join(offsets, [*by, "__part"])
    return joined.withColumn(out, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in code."""
    return spark.createDataFrame(rows, schema)
