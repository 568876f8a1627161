"""A sink that holds each batch of a stream once, however often it is run, and a runner that begins again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def once(path: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is the folder of its number and is written over when it is run again, as its rows are the
    same then. after(number) is called between a batch's write and its commit."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    return write


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches, without their number."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def run_to_end(out: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None, tries: int = 3) -> dict[int, int]:
    """Runs a stream over what is there, into a sink of `once`, and begins again from its checkpoint when it fails.

    Gives the rows behind the watermark that each batch dropped, by the batch's number; a batch that is run again counts
    with its last run.
    """
    dropped: dict[int, int] = {}
    for left in range(tries - 1, -1, -1):
        query = out.writeStream.foreachBatch(once(path, after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        failed = None
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            failed = e
        for p in query.recentProgress:
            dropped[p.batchId] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if failed is None:
            return dropped
        if not left:
            raise failed
    return dropped


def numbered(rows: DataFrame, at: str, part: Column, parts: int) -> None:
    """Writes rows as a folder of files that a stream reads one after another: those of part 0, 1 and so on. The rows are
    read once, by all tasks; then each file takes a task that reads its own part only."""
    rows.withColumn("__part", part.cast("int")).write.partitionBy("__part").parquet(f"{at}-parts")
    dealt = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("__part", IntegerType())])).parquet(f"{at}-parts")
    for i in range(parts):
        dealt.filter(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(at)
