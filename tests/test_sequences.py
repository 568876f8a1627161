"""Smoother and matcher against a plain state machine on random frames, and the behaviours one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigilframe.operators import sequences as sq
from sigilframe.operators.sequences import Pattern, Smoothing
from sigilframe.streaming.matching import SessionState

SHORT = Pattern("Short", ("tiger", "snake"))
LONG = Pattern("Long", ("ram", "monkey", "tiger", "snake"))
OTHER = Pattern("Other", ("ox", "hare", "monkey"))
FRAMES = "session long, frame long, ts timestamp, sign string"
START = datetime(2024, 1, 1)


def frames(spark, sessions: dict[int, list[tuple[float, str | None]]]):
    rows = [(k, i, START + timedelta(seconds=t), s) for k, fs in sessions.items() for i, (t, s) in enumerate(fs)]
    return spark.createDataFrame(rows, FRAMES)


class Tried(SessionState):
    """The streaming twin's state, with every pattern tried one after another."""

    def add(self, sign, known, most):
        self.idle = None
        if self.buffer and self.buffer[-1] == sign:
            return None
        self.buffer = [*self.buffer, sign][-most:]
        for p in known:
            if tuple(self.buffer[-len(p.signs) :]) == p.signs:
                self.buffer = []
                return p
        return None


def plain(fs, patterns, s, timeout):
    """Emissions of one session by a loop."""
    state, out, ordered = Tried(), [], sq.longest_first(patterns)
    for i, (t, sign) in enumerate(fs):
        e = state.vote(sign, s)
        if e is not None:
            p = state.add(e, ordered, 16)
            out.append((i, e, p.name if p else None, tuple(state.buffer)))
        state.tick(round(t * 1e6), round(timeout * 1e6))
    return out


@pytest.mark.parametrize(("window", "votes", "clear"), [(1, 1, 1), (5, 3, 2), (9, 3, 4), (5, 2, 2)])
def test_equals_a_state_machine(spark, window, votes, clear):
    rnd = random.Random(window * 100 + votes)
    sessions = {}
    for k in range(12):
        t, fs = 0.0, []
        for _ in range(150):
            t += rnd.choice([0.1, 0.1, 0.1, 2.0])
            fs += [(t + j * 0.01, x) for j, x in enumerate([rnd.choice(["tiger", "snake", "ram", "monkey", None])] * rnd.randint(1, 4))]
        sessions[k] = fs
    s = Smoothing(window, votes, clear)
    got = sq.trace(frames(spark, sessions), [SHORT, LONG, OTHER], s, 1.5).collect()
    want = {(k, *row) for k, fs in sessions.items() for row in plain(fs, [SHORT, LONG, OTHER], s, 1.5)}
    assert {(r.session, r.frame, r.sign, r.pattern, tuple(r.buffer)) for r in got} == want
    assert len(want) > 100


def test_a_misread_frame_changes_nothing(spark):
    fs = [(i * 0.03, x) for i, x in enumerate(["hare"] * 6 + ["monkey"] + ["hare"] * 6)]
    out = sq.smooth(frames(spark, {1: fs}), Smoothing(9, 6, 6)).filter("emitted is not null").collect()
    assert [(r.frame, r.emitted) for r in out] == [(5, "hare")]


def test_noisy_clip_gives_one_match(spark):
    signs = ["tiger"] * 7 + ["snake"] + ["tiger"] * 3 + [None] * 9 + ["snake"] * 7 + ["tiger"] + ["snake"] * 3
    fs = [(i * 0.03, x) for i, x in enumerate(signs)]
    got = sq.match_sequences(frames(spark, {1: fs}), [SHORT, LONG], Smoothing(9, 6, 6)).collect()
    assert [r.pattern for r in got] == ["Short"]


def test_longest_pattern_wins_and_a_long_hold_keeps_the_buffer(spark):
    signs = [(0.0, "ram"), (1.0, "monkey"), (2.0, "tiger")] + [(2.0 + i, "tiger") for i in range(1, 20)] + [(22.0, "snake")]
    got = sq.match_sequences(frames(spark, {1: signs}), [SHORT, LONG], Smoothing(1, 1, 1)).collect()
    assert [r.pattern for r in got] == ["Long"]


def test_idle_clears_after_the_timeout_only(spark):
    def run(gap):
        fs = [(0.0, "tiger"), (0.1, None), (0.1 + gap, None), (0.2 + gap, "snake")]
        return [r.pattern for r in sq.match_sequences(frames(spark, {1: fs}), [SHORT], Smoothing(1, 1, 1), 3.0).collect()]

    assert run(3.0) == ["Short"]
    assert run(3.01) == []


def test_states_of_frames(spark):
    fs = [(0.0, "tiger"), (1.0, None), (2.0, None), (5.0, None), (6.0, "snake")]
    rows = sq.frame_states(frames(spark, {1: fs}), [SHORT], Smoothing(1, 1, 1), 3.0, 3.0).orderBy("frame").collect()
    assert [(r.buffered, r.time_left) for r in rows] == [(1, None), (1, 3.0), (1, 2.0), (0, None), (1, None)]


def test_thresholds_above_the_window_are_refused():
    with pytest.raises(ValueError):
        Smoothing(5, 6)
    assert Smoothing(window=9, min_votes=6).clear == 4


def test_no_frames(spark):
    empty = spark.createDataFrame([], FRAMES)
    assert sq.trace(empty, [SHORT], Smoothing(3, 2, 2)).count() == 0


def test_unreachable(spark):
    rows = [(0, "A", ["x", "y"]), (1, "B", ["z", "x", "y", "w"]), (2, "C", ["w", "x", "y"])]
    out = sq.unreachable(spark.createDataFrame(rows, "place int, name string, signs array<string>")).collect()
    assert [(r.name, r.blocked_by, r["at"]) for r in out] == [("B", "A", 3)]


def most_joined(plan):
    """The most rows that a join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_joined(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_joined(plan.plan())
    below = plan.children()
    own = plan.metrics().get("numOutputRows").get().value() if kind.endswith("JoinExec") else 0
    return max([own, *(most_joined(below.apply(i)) for i in range(below.size()))])


def test_unreachable_does_not_pair_equal_signs(spark):
    """Of many patterns with the same signs each is told once; the rows on the way don't grow with their square."""
    signs = [["x", "y"], ["z", "x", "y", "w"], ["x"], []]
    df = spark.createDataFrame([(i, f"p{i}", signs[i % 4]) for i in range(1600)], "place int, name string, signs array<string>")
    out = sq.unreachable(df)
    rows = {r.name: (r.blocked_by, r["at"]) for r in out.collect()}
    assert rows == {f"p{i}": ("p2", 1) if i % 4 == 0 else ("p0", 3) for i in range(1600) if i % 4 < 2}
    assert most_joined(out._jdf.queryExecution().executedPlan()) <= 1600


def test_progress_ranks_by_depth(spark):
    fs = [(0.0, "ram"), (1.0, "monkey"), (2.0, "tiger")]
    traced = sq.trace(frames(spark, {1: fs}), [SHORT, LONG], Smoothing(1, 1, 1))
    out = sq.progress(traced, [SHORT, LONG]).filter("frame = 2").orderBy("rank").collect()
    assert [(r.pattern, r.depth) for r in out] == [("Long", 3), ("Short", 1)]


def test_plan_has_one_exchange_by_session(spark, sf_dir):
    from sigilframe.plans.sequence_queries import SMOOTHING, frames as read

    plan = sq.smooth(read(spark, sf_dir), SMOOTHING)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_rolling_rate(spark):
    fs = [(i * 0.5, "ram") for i in range(5)]
    out = sq.rolling_rate(frames(spark, {1: fs})).orderBy("frame").select(F.round("fps", 6)).collect()
    assert [r[0] for r in out] == [None, 2.0, 2.0, 2.0, 2.0] or [r[0] for r in out][1:] == [2.0] * 4
