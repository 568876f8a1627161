"""Distances of distributions by their definition, sketches within their error, running sums over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sigilframe.operators import audit
from sigilframe.plans import audit_queries
from sigilframe.session import running_sum


def by_definition(rows):
    out = {}
    sources = {s for s, _ in rows}
    for s in sources:
        own, rest = [v for x, v in rows if x == s], [v for x, v in rows if x != s]
        share = lambda values, at: sum(v <= at for v in values) / len(values)
        out[s] = max(abs(share(own, v) - share(rest, v)) for _, v in rows) if rest else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_distances(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, round(rnd.gauss(s / 3, 1), rnd.choice([0, 1, 3]))) for s in range(1, 5) for _ in range(rnd.choice([1, 40, 120]))]
    df = spark.createDataFrame([*rows, (1, None)], "source int, v double").repartition(3).cache()
    got = {r.source: r.distance for r in audit.distances(df, "v").collect()}
    assert got == pytest.approx(by_definition(rows))
    near = {r.source: r.distance for r in audit.sketched_distances(audit.sketches(df, "v")).collect()}
    assert near == pytest.approx(got, abs=audit.SKETCH_ERROR)


def test_sketches_of_many_rows(spark):
    """Beyond a sketch's size, within the stated error; sketches of parts merge."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("source"), (F.sin(F.col("id")) + F.col("id") % 3 / 5 + F.rand(1)).alias("v")).checkpoint()
    exact = {r.source: r.distance for r in audit.distances(df, "v").collect()}
    near = {r.source: r.distance for r in audit.sketched_distances(audit.sketches(df, "v")).collect()}
    assert near == pytest.approx(exact, abs=audit.SKETCH_ERROR) and max(exact.values()) > 0.1


def test_one_source_has_no_rest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "source string, v double")
    assert [r.distance for r in audit.distances(df, "v").collect()] == [None]
    assert [r.distance for r in audit.sketched_distances(audit.sketches(df, "v")).collect()] == [None]
    assert audit.distances(df.limit(0), "v").collect() == []


def test_running_sum(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(40), rnd.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = sorted(map(tuple, running_sum(df, ["g"], "v", "k", "upto").select("g", "v", "k", "upto").collect()))
    assert got == sorted((g, v, k, sum(c for h, w, c in rows if h == g and w <= v)) for g, v, k in rows)


def test_the_turned_source_stands_apart(spark, sf_dir):
    """And by far more than sketches err."""
    rows = audit_queries.geometry_distances(spark, sf_dir).collect()
    assert {r.source for r in rows if r.aspect > audit_queries.APART + 2 * audit.SKETCH_ERROR} == {audit_queries.TURNED}
    assert all(r.aspect < audit_queries.APART - 2 * audit.SKETCH_ERROR for r in rows if r.source != audit_queries.TURNED)
    assert all(abs(r.height - audit_queries.APART) > 2 * audit.SKETCH_ERROR for r in rows)


def test_report_leaves_out_boxes_without_area(spark):
    df = spark.createDataFrame([("a", 0.5, 0.2, 0.4, 0.2), ("a", 0.5, 0.6, 0.0, 0.2)], "source string, xc double, yc double, w double, h double")
    assert [tuple(r) for r in audit.geometry_report(df).collect()] == [("a", 1, 0.4, 0.2, 2.0, 0.2, 1.0)]
