"""The matcher as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences
from ..session import ensure_checkpoint_dir, table
from ..streaming.matching import EXPIRIES, OUTPUT, expiry_stream, match_stream
from ..streaming.once import numbered, read_once, run_to_end
from .sequence_queries import ACCEPT, DAY, FOLDED, PATTERNS, SMOOTHING, frames

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[str]:
    """State in RocksDB, and a new folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads events as a stream until its end, and returns what the stream wrote to the shared folder."""
    path = f"{sf_dir}/events.parque[t]"  # as a pattern it may be a file or a folder
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    frames = events.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("frame"),
        F.col("ts").cast("timestamp").alias("ts"),
        sequences.vote_gate(F.col("event_type"), F.col("value"), ACCEPT).alias("sign"),
    )
    with rocks(spark) as at:
        out = match_stream(frames, PATTERNS, SMOOTHING, DAY)
        writer = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").select("session", "frame", "sign", "pattern")


#: Days of January 2024 at which a new file of events begins; events of every LATE-th number come in a file of their own
#: after those, and the watermark is LATENESS behind.
CUTS, LATE, LATENESS = (9, 17, 25), 40, "5 days"
FAR = "2100-01-01 00:00:00"


def in_files(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """A stream of files of frames: by day, then the late ones, then a frame so far ahead that all before it is done."""
    held = frames(spark, sf_dir)
    part = F.when(F.col("frame") % LATE == 0, len(CUTS) + 1).otherwise(sum(((F.col("ts") >= F.lit(f"2024-01-{d:02d}").cast("timestamp")).cast("int") for d in CUTS), F.lit(0)))
    numbered(held, at, part, len(CUTS) + 2)
    last = spark.createDataFrame([(-1, -1, FAR, None)], "session long, frame long, ts string, sign string")
    last.select("session", "frame", F.col("ts").cast("timestamp").alias("ts"), "sign").coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(at)


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream fails after a batch was written and before it is committed, and begins again from its checkpoint. Its sink
    holds every batch once; frames behind the watermark are dropped and counted."""
    with rocks(spark) as at:
        out = match_stream(in_files(spark, sf_dir, f"{at}/in"), PATTERNS, SMOOTHING, DAY, lateness=LATENESS)
        failures = [2]

        def fail_once(number: int) -> None:
            if number in failures:
                failures.remove(number)
                raise RuntimeError("stopped between a batch and its commit")

        dropped = run_to_end(out, f"{at}/out", f"{at}/state", fail_once)
        if failures:
            raise RuntimeError("there was no batch to fail at")
    rows = read_once(spark, f"{at}/out", OUTPUT)
    return rows.select("session", "frame", "sign", "pattern", F.lit(sum(dropped.values())).cast("bigint").alias("dropped"))


def stream_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiries by event-time timers, of sessions that end as of those that go on."""
    with rocks(spark) as at:
        out = expiry_stream(in_files(spark, sf_dir, f"{at}/in"), PATTERNS, SMOOTHING, DAY, "60 days")
        run_to_end(out, f"{at}/out", f"{at}/state")
    rows = read_once(spark, f"{at}/out", EXPIRIES)
    return rows.select("session", *(F.unix_micros(c).alias(c) for c in ("idle_since", "at")), F.col("signs").cast("bigint").alias("signs"))


def idle_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.idle_expiries(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY)
    return rows.select("session", *(F.unix_micros(c).alias(c) for c in ("idle_since", "at")), F.col("signs").cast("bigint").alias("signs"))


#: Late frames are dropped where they aren't after the watermark that was in force in the batch before theirs, which
#: the files before that one gave.
IN_TIME = f"""(SELECT * FROM events, (SELECT max(ts) - INTERVAL {LATENESS} AS mark FROM events WHERE event_id % {LATE} <> 0 AND ts < TIMESTAMP '2024-01-{CUTS[-1]:02d}')
 WHERE event_id % {LATE} <> 0 OR ts > mark)"""
STREAM_RESTART = f"""
WITH RECURSIVE {FOLDED.replace('FROM events)', f'FROM {IN_TIME})')}
SELECT session, frame, sign, pattern, (SELECT count(*) FROM events) - (SELECT count(*) FROM {IN_TIME}) AS dropped FROM t WHERE k > 0
"""

#: The matcher with buffers that expire by the time between letting go and the next emission.
TIMED = FOLDED[: FOLDED.index("em AS (")] + f"""
o AS (SELECT session, frame, ts, emitted, epoch_us(st) AS st FROM y WHERE emitted IS NOT NULL OR st IS NOT NULL),
n AS (SELECT *, lag(st) OVER w AS since, lead(st) OVER w AS idle, epoch_us(lead(ts, 2) OVER w) AS nxt FROM o WINDOW w AS (PARTITION BY session ORDER BY ts, frame)),
em AS (SELECT session, frame, ts, emitted, CAST(0 AS HUGEINT) AS expirations, idle, nxt, row_number() OVER (PARTITION BY session ORDER BY ts, frame) AS k,
              coalesce(epoch_us(ts) - since > {DAY} * 1000000, FALSE) AS reset FROM n WHERE emitted IS NOT NULL),
""" + FOLDED[FOLDED.index("t AS (\n") :]
EXPIRED = f"""
WITH RECURSIVE {TIMED}
SELECT em.session, em.idle AS idle_since, CAST(em.idle + {DAY} * 1000000 AS BIGINT) AS "at", CAST(len(t.buffer) AS BIGINT) AS signs
FROM em JOIN t USING (session, frame) WHERE len(t.buffer) > 0 AND em.idle IS NOT NULL AND (em.nxt IS NULL OR em.nxt - em.idle > {DAY} * 1000000)
"""

QUERIES = {f.__name__: f for f in (stream_match, stream_restart, stream_expiries, idle_expiries)}
ORACLES = {
    "stream_match": f"WITH RECURSIVE {FOLDED} SELECT session, frame, sign, pattern FROM t WHERE k > 0",
    "stream_restart": STREAM_RESTART,
    "stream_expiries": EXPIRED,
    "idle_expiries": EXPIRED,
}
