"""Queries over one session without end: all events are frames of it. It is cut into blocks, so no task holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks
from ..session import table
from .sequence_queries import SMOOTHED, SMOOTHING, frames

#: Frames of a block.
BLOCK = 4096


def one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("session", F.lit(0))


def endless_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = blocks.smooth_blocks(one_session(spark, sf_dir), SMOOTHING, BLOCK)
    return smoothed.select("frame", "held", "emitted", F.round("stability", 6).alias("stability"))


ENDLESS_SIGNS = f"""
WITH {SMOOTHED.replace('user_id AS session', '0 AS session')}
SELECT frame, held, emitted, CASE WHEN held IS NULL THEN 0.0::DOUBLE ELSE round(len(list_filter(win, lambda s: s = held)) / 3.0::DOUBLE, 6) END AS stability FROM e
"""


def endless_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = blocks.rolling_rate_blocks(one_session(spark, sf_dir), 30, BLOCK)
    return rated.select("frame", F.round(F.col("fps") * 3600, 6).alias("per_hour"))


ENDLESS_RATE = """
WITH g AS (SELECT event_id AS frame, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT frame, round(count(gap) OVER w / greatest(coalesce(sum(gap) OVER w, 1e-6), 1e-6) * 3600, 6) AS per_hour
FROM g WINDOW w AS (ORDER BY ts, frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""


def endless_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    yaw = F.when(F.col("event_type") != "error", F.col("value") / 245 - 1)
    rows = e.select(F.lit(0).alias("session"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), yaw.alias("yaw"))
    out = blocks.moving_average(rows, "yaw")
    return out.select("frame", F.round("average", 6).alias("yaw"))


#: What lies 120 values back weighs 0.7 ** 120, less than any digit that is shown.
ENDLESS_YAW = """
WITH b AS (SELECT event_id AS frame, ts, CASE WHEN event_type <> 'error' THEN value / 245 - 1 END AS v FROM events),
n AS (SELECT frame, ts, list(v) OVER (ORDER BY ts, frame ROWS 119 PRECEDING) AS w FROM b WHERE v IS NOT NULL),
y AS (SELECT frame, list_sum(list_transform(w, lambda x, i: x * 0.3::DOUBLE * pow(0.7::DOUBLE, len(w) - i))) AS y FROM n)
SELECT b.frame, round(coalesce(last_value(y.y IGNORE NULLS) OVER (ORDER BY b.ts, b.frame ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE), 6) AS yaw FROM b LEFT JOIN y USING (frame)
"""

QUERIES = {f.__name__: f for f in (endless_signs, endless_rate, endless_yaw)}
ORACLES = {"endless_signs": ENDLESS_SIGNS, "endless_rate": ENDLESS_RATE, "endless_yaw": ENDLESS_YAW}
