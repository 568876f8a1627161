"""Functions over blocks against the same over whole sessions, and the size of what a task holds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sigilframe.operators import blocks, sequences
from sigilframe.operators.sequences import Smoothing


@pytest.fixture(scope="module")
def frames(spark):
    """Two long sessions, many short ones, a null one; runs of signs and gaps, equal times."""
    rnd = random.Random(3)
    rows, frame = [], 0
    for session, n in [(1, 400), (2, 260), (None, 50), *((i, rnd.randint(1, 6)) for i in range(10, 40))]:
        sign, ts = None, 1_700_000_000.0
        for _ in range(n):
            if rnd.random() < 0.25:
                sign = rnd.choice([None, None, "ox", "ram", "rat"])
            ts += rnd.choice([0, 0.03, 0.04, 5])
            rows.append((session, frame, ts, sign))
            frame += 1
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "session int, frame long, ts double, sign string")
    return df.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).repartition(5).cache()


@pytest.mark.parametrize("s", [Smoothing(3, 2, 2), Smoothing(7, 3, 4), Smoothing(25, 18), Smoothing(1, 1, 1)])
@pytest.mark.parametrize("block", [25, 64, 10_000])
def test_smooth_equals_whole_sessions(frames, s, block):
    columns = ["session", "frame", "held", "emitted", "stability"]
    want = sorted(map(tuple, sequences.smooth(frames, s).select(columns).collect()), key=repr)
    got = sorted(map(tuple, blocks.smooth_blocks(frames, s, block).select(columns).collect()), key=repr)
    assert got == want and any(r[3] for r in got)


@pytest.mark.parametrize("block", [30, 77])
def test_rate_equals_whole_sessions(frames, block):
    rounded = lambda df: sorted(((r.session, r.frame, round(r.fps, 6)) for r in df.collect()), key=repr)
    assert rounded(blocks.rolling_rate_blocks(frames, 30, block)) == rounded(sequences.rolling_rate(frames, 30))


@pytest.mark.parametrize("size,rate,start", [(2, 0.3, 0.0), (8, 0.3, 1.5), (16, 1.0, 2.0), (1024, 0.01, -1.0)])
def test_average_equals_a_loop(spark, size, rate, start):
    rnd = random.Random(size)
    rows = [(rnd.choice([1, 1, 1, 2, None, 7]), i, i // 2, None if rnd.random() < 0.3 else rnd.uniform(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "session int, frame long, ts long, v double").repartition(4)
    got = {(r.session, r.frame): r.average for r in blocks.moving_average(df, "v", rate, start, size).collect()}
    state = {}
    for session, frame, _, v in rows:
        y = state.get(session, start)
        state[session] = y if v is None else y + (v - y) * rate
        assert got[session, frame] == pytest.approx(state[session], abs=1e-9)
    assert len(got) == len(rows)


def test_no_task_holds_a_session(frames):
    placed = blocks.blocked(frames.withColumn("session", F.lit(1)), 40)
    sizes = [r["count"] for r in blocks.with_halo(placed, 40, 24).groupBy("block").count().collect()]
    assert max(sizes) == 64 and len(sizes) > 15
    plan = blocks.smooth_blocks(frames, Smoothing(3, 2, 2), 40)._jdf.queryExecution().optimizedPlan().toString()
    parts = [re.search(r"\[([^\[\]]*)\], \[[^\[\]]*\]$", x) for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window ")]
    # one window is over a session: that which carries what a block tells to those after it, a row a block
    assert sorted({m[1].split("#")[0] for m in parts if m} | {"sum(__n"}) == ["block", "session", "sum(__n"]  # the last: of counts by partition, in ordered_index
    assert sum(m[1].startswith("session#") for m in parts if m) == 1


def test_average_takes_no_python(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5)], "session int, frame long, ts long, v double")
    plan = blocks.moving_average(df, "v")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_halo_is_at_most_a_block(frames):
    with pytest.raises(ValueError):
        blocks.smooth_blocks(frames, Smoothing(25, 18), 20)


def test_no_frames(frames):
    none = frames.limit(0)
    assert blocks.smooth_blocks(none).collect() == []
    assert blocks.rolling_rate_blocks(none).collect() == []
    assert blocks.moving_average(none.withColumn("v", F.lit(1.0)), "v").collect() == []
