"""The automaton against trying every pattern, and the interval join against all pairs."""

import random

import pytest

from sigilframe.operators import intervals, sequences
from sigilframe.operators.pattern_automaton import PatternAutomaton
from sigilframe.operators.sequences import Pattern, longest_first


def tried(signs, patterns, most, dedupe=True):
    """The rules as they are said: add, keep the last, try the longest first, clear."""
    buffer, out = [], []
    for sign in signs:
        found = None
        if not (dedupe and buffer and buffer[-1] == sign):
            buffer = [*buffer, sign][-most:]
            for p in longest_first(patterns):
                if p.signs and tuple(buffer[-len(p.signs) :]) == p.signs:
                    found, buffer = (p.name, len(p.signs)), []
                    break
        out.append((list(buffer), found))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_one_transition_equals_trying_all(seed):
    rnd = random.Random(seed)
    letters = "abc" if seed % 2 else "abcdef"
    patterns = [Pattern(f"p{i}", tuple(rnd.choice(letters) for _ in range(rnd.randint(1 + seed % 3, 7)))) for i in range(40)]
    most = rnd.choice([3, 5, 16])
    signs = [rnd.choice(letters) for _ in range(2000)]
    known = sequences.automaton(patterns, most)
    buffer, node = [], 0
    for sign, (want, match) in zip(signs, tried(signs, patterns, most), strict=True):
        found = None
        if not (buffer and buffer[-1] == sign):
            buffer, node = [*buffer, sign][-most:], known.step(node, sign)
            found = known.longest[node]
            if found:
                buffer, node = [], 0
        assert (buffer, found) == (want, match)
        depths = {}
        for end, depth in known.ends(node):
            for place in known.begins[end]:
                depths.setdefault(known.names[place], depth)
        plain = {p.name: max((d for d in range(1, min(len(p.signs), len(buffer)) + 1) if list(p.signs[:d]) == buffer[-d:]), default=0) for p in patterns}
        assert depths == {k: v for k, v in plain.items() if v}


def test_steps_do_not_grow_with_patterns():
    """Failure links are followed at most as often as signs were taken before, however many patterns there are."""

    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return super().__getitem__(i)

    rnd = random.Random(1)
    signs, told = [rnd.choice("abcde") for _ in range(5000)], []
    for n in (10, 4000):
        known = PatternAutomaton((f"p{i}", tuple(rnd.choice("abcde") for _ in range(rnd.randint(6, 12)))) for i in range(n))
        known.fail, Counted.looked, node = Counted(known.fail), 0, 0
        for s in signs:
            node = known.step(node, s)
        told.append(Counted.looked)
    assert max(told) <= len(signs)


def test_equal_signs_and_long_patterns():
    known = PatternAutomaton([("first", ("a", "b")), ("second", ("a", "b")), ("long", ("x",) * 5), ("none", ())], 3)
    node = known.step(known.step(0, "a"), "b")
    assert known.longest[node] == ("first", 2)
    node = 0
    for _ in range(6):
        node = known.step(node, "x")
        assert known.longest[node] is None
    assert known.depth[node] == 3


def test_intervals_equal_all_pairs(spark):
    rnd = random.Random(9)
    points = [(i, rnd.choice([None, *[rnd.uniform(-50, 50)] * 9])) for i in range(300)] + [(1000 + i, float(i)) for i in range(-5, 6)]
    held = [(i, lo := float(rnd.randint(-60, 60)), lo + rnd.choice([0.0, 0.5, 1.0, 3.0, 40.0, 200.0, -1.0])) for i in range(120)] + [(500, None, 3.0), (501, 2.0, None)]
    p = spark.createDataFrame(points, "id long, at double")
    h = spark.createDataFrame(held, "k long, low double, high double")
    want = {(i, k) for i, x in points for k, lo, hi in held if None not in (x, lo, hi) and lo <= x <= hi}
    for width in (None, 0.3, 7.0, 1000.0):
        rows = [(r.id, r.k) for r in intervals.join_intervals(p, h, "at", "low", "high", width).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    first = {i: min(((lo, k) for k, lo, hi in held if None not in (x, lo, hi) and lo <= x <= hi)) for i, x in points if any(a == i for a, _ in want)}
    got = {r.id: (r.low, r.k) for r in intervals.first_interval(p, h, ["id"], "at", "low", "high", ["low", "k"]).collect()}
    assert got == first


def test_intervals_take_no_nested_loop(spark, sf_dir):
    from sigilframe.plans import model_queries

    for query in (model_queries.busy_hours, model_queries.colour_ramp):
        plan = query(spark, sf_dir)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_intervals(spark):
    p = spark.createDataFrame([(1, 1.0)], "id long, at double")
    h = spark.createDataFrame([], "k long, low double, high double")
    assert intervals.join_intervals(p, h, "at", "low", "high").collect() == []
    assert intervals.first_interval(p, h, ["id"], "at", "low", "high", ["low"]).collect() == []
