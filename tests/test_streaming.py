"""The stream's rows equal the batch's, in order and with late frames inside the watermark."""

import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigilframe.operators import sequences
from sigilframe.plans import sequence_queries as q
from sigilframe.plans.stream_queries import ROCKS
from sigilframe.streaming import once
from sigilframe.streaming.matching import EXPIRIES, OUTPUT, ExpiryProcessor, MatchProcessor, SessionState, expiry_stream, match_stream


@pytest.mark.parametrize("mixed", [False, True])
def test_stream_equals_batch(spark, sf_dir, tmp_path, mixed):
    frames = q.frames(spark, sf_dir).filter("session % 3 = 0")
    for i in range(3):
        part = frames.filter(F.col("frame") % 3 == i) if mixed else frames.filter(F.floor(F.col("frame") / 334) == i)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([(-1, -1, "2100-01-01 00:00:00", None)], "session long, frame long, ts string, sign string")
    last.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = match_stream(source, q.PATTERNS, q.SMOOTHING, q.DAY, lateness="400 days" if mixed else "0 seconds")
    writer = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.session, r.frame, r.sign, r.pattern or "") for r in df.collect())
    batch = q.sequence_trace(spark, sf_dir).filter("session % 3 = 0")
    got = key(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"))
    assert got == key(batch) and got


def expired(fs, s, timeout):
    """Expiries of one session's frames (micros, sign) by a loop; a clock runs between frames and after the last."""
    state, known, out = SessionState(), sequences.automaton(q.PATTERNS), []
    for ts, sign in [*fs, (None, None)]:
        if state.idle is not None and (ts is None or ts - state.idle > timeout):
            out.append((state.idle, state.idle + timeout, len(state.buffer)))
            state.clear()
        if ts is None:
            return out
        emitted = state.vote(sign, s)
        if emitted is not None:
            state.add(emitted, known, 16)
        if state.held is not None or not state.buffer:
            state.idle = None
        elif state.idle is None:
            state.idle = ts


@pytest.fixture(scope="module")
def clips():
    rnd, out = random.Random(8), {}
    for session in range(40):
        ts, sign, fs = 1_700_000_000_000_000, None, []
        for _ in range(rnd.randint(1, 120)):
            if rnd.random() < 0.4:
                sign = rnd.choice([None, None, "view", "click", "error", "signup"])
            ts += rnd.choice([200_000, 500_000, 1_000_000, 4_000_000])
            fs.append((ts, sign))
        out[session] = fs
    return out


@pytest.mark.parametrize("timeout", [1.0, 3.0, 3.2])
def test_expiries_need_no_next_frame(spark, tmp_path, clips, timeout):
    s = sequences.Smoothing(3, 2, 2)
    rows = [(k, i, t, sign) for k, fs in clips.items() for i, (t, sign) in enumerate(fs)]
    df = spark.createDataFrame(rows, "session long, frame long, ts long, sign string").withColumn("ts", F.timestamp_micros("ts"))
    want = sorted((k, *x) for k, fs in clips.items() for x in expired(fs, s, round(timeout * 1e6)))
    micros = lambda d: sorted((r.session, r.since, r.at, r.signs) for r in d.select("session", F.unix_micros("idle_since").alias("since"), F.unix_micros("at").alias("at"), "signs").collect())
    assert micros(sequences.idle_expiries(df, q.PATTERNS, s, timeout)) == want and len(want) > 30
    if timeout != 3.0:
        return
    at = str(tmp_path)
    once.numbered(df, f"{at}/in", F.col("frame") % 3, 3)
    last = spark.createDataFrame([(-1, -1, 4_000_000_000_000_000, None)], "session long, frame long, ts long, sign string")
    last.withColumn("ts", F.timestamp_micros("ts")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    once.run_to_end(expiry_stream(source, q.PATTERNS, s, timeout, "1 hour"), f"{at}/out", f"{at}/state")
    assert micros(once.read_once(spark, f"{at}/out", EXPIRIES)) == want


def test_every_batch_is_held_once(spark, tmp_path):
    """Failures before and after a commit: what a batch wrote is written over, not added to."""
    at, df = str(tmp_path), spark.range(90).withColumn("part", F.col("id") % 3)
    once.numbered(df, f"{at}/in", F.col("part"), 3)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    failures, seen = [0, 1, 1], []

    def after(number):
        seen.append(number)
        if failures and number == failures[0]:
            failures.pop(0)
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        once.run_to_end(source, f"{at}/out", f"{at}/state", after, tries=2)
    once.run_to_end(source, f"{at}/out", f"{at}/state", after)
    assert seen == [0, 0, 1, 1, 1, 2]
    assert sorted(r.id for r in once.read_once(spark, f"{at}/out", "id long, part long").collect()) == list(range(90))


def test_reset_clears_the_session(spark, tmp_path):
    """A frame whose control is reset clears window, held sign and buffer."""
    rows = [(1, i, i * 1_000_000, s, c) for i, (s, c) in enumerate([("click", None), ("click", None), (None, "reset"), ("error", None), ("error", None), ("click", None), ("click", None), ("error", None), ("error", None)])]
    df = spark.createDataFrame(rows, "session long, frame long, ts long, sign string, control string").withColumn("ts", F.timestamp_micros("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = match_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), q.PATTERNS, sequences.Smoothing(2, 2, 2), 100.0)
    once.run_to_end(out, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.frame, r.sign, r.pattern) for r in once.read_once(spark, f"{tmp_path}/out", OUTPUT).collect())
    assert got == [(1, "click", None), (4, "error", None), (6, "click", None), (8, "error", "broken click")]


class Kept:
    """Of a bucket, what Spark hands over with its rows."""

    exists, hasTimedOut, mark, wake = False, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.mark
        self.wake = ms

    def update(self, value):
        self.exists, self.get = True, value


def test_sessions_of_a_bucket_share_calls():
    """Sessions in one call give what each gives in calls of its own, also null and large ones; those without rows or
    something due aren't looked at."""
    rnd, sessions = random.Random(5), [None, str(2**60 + 1), "5", "-7"]
    rows = [(s, i, i * 1_000_000, rnd.choice(["click", "click", "error", None]), None) for i in range(80) for s in sessions]
    worked = []

    class Watched(ExpiryProcessor):
        def work(self, session, *a):
            worked.append(session)
            return super().work(session, *a)

    for kind in (MatchProcessor, ExpiryProcessor):

        def run(own, kind=kind):
            processor, state, out = kind(q.PATTERNS, sequences.Smoothing(3, 2, 2), 2.0, 16, True), Kept(), []
            for part, mark in ((0, 0), (1, 20_000), (2, 45_000), (None, 200_000)):
                state.mark, state.hasTimedOut = mark, part is None
                given = pd.DataFrame([r for r in rows if r[0] in own and r[1] % 3 == part], columns=["session", "frame", "micros", "sign", "control"], dtype=object)
                for pdf in processor.handle((0,), iter([given]), state):
                    out += [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
            return out

        apart = [r for s in sessions for r in run([s])]
        together = run(sessions)
        by = lambda r: tuple(map(str, r))
        assert sorted(together, key=by) == sorted(apart, key=by) and {r[0] for r in together} == {None, 2**60 + 1, 5, -7}
    processor, state = Watched(q.PATTERNS, sequences.Smoothing(3, 2, 2), 2.0, 16, True), Kept()
    given = lambda s: pd.DataFrame([r for r in rows if r[0] in s], columns=["session", "frame", "micros", "sign", "control"], dtype=object)
    list(processor.handle((0,), iter([given(sessions)]), state))
    worked.clear()
    list(processor.handle((0,), iter([given(["5"]).head(1)]), state))
    assert worked == [5]


def test_rows_are_read_once_for_all_files(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    once.numbered(spark.range(60).mapInArrow(count, "id long"), f"{tmp_path}/in", F.col("id") % 3, 4)
    assert seen.value == 60
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/in").collect()) == list(range(60))
