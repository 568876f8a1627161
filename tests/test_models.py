"""Evaluation, tracking and effects."""

import math

import pytest
from pyspark.sql import functions as F

from sigilframe.functions import effects as fx
from sigilframe.functions import geometry as g
from sigilframe.functions.vocabulary import class_table
from sigilframe.operators import blocks, evaluation, tracking


def test_absent_class_has_no_score(spark):
    given = spark.createDataFrame([([2, 0], [0.5, 0.91237], [0.1, 0.2], [0.3, 0.4], [0.5, 0.6])], "ap_class_index array<int>, ap50 array<double>, ap array<double>, p array<double>, r array<double>")
    out = {r.class_id: r.AP50 for r in evaluation.summarize(given, class_table(spark)).collect()}
    assert out[0] == 0.9124 and out[2] == 0.5 and out[5] is None and len(out) == 12
    assert [r.name for r in evaluation.weakest(evaluation.summarize(given, class_table(spark))).collect()] == ["dog", "bird"]


def test_parity_counts_missing_detections(spark):
    a = spark.createDataFrame([("x", 1, 0.5), ("y", 2, 0.5)], "image string, cls int, conf double")
    b = spark.createDataFrame([("x", 1, 0.75), ("z", 3, 0.9)], "image string, cls int, conf double")
    r = evaluation.parity(a, b).first()
    assert (r.images, r.agree, r.max_delta) == (3, 1, 0.25)


def test_held_out_falls_back_to_all(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string")
    assert evaluation.held_out_or_all(rows, "b").count() == 1
    assert evaluation.held_out_or_all(rows, "none").count() == 2


def test_letterbox_there_and_back(spark):
    r = spark.range(1).select(g.letterbox(F.lit(1280.0), F.lit(720.0)).alias("f")).select("f.*").first()
    assert (r.scale, r.pad_left, r.pad_top) == (0.5, 0.0, 140.0)


def test_iou(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)])
    r = spark.range(1).select(g.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), g.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("c")).first()
    assert r.a == pytest.approx(1 / 7) and r.b == 0 and r.c == 0


def anchor(spark, boxes, step=1 / 30):
    rows = [(1, i, i * step, b) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "session long, frame long, ts double, box struct<x1:double,y1:double,x2:double,y2:double>")
    return tracking.track_anchor(df).orderBy("frame").collect()


def square(x, y=100.0, half=20.0):
    return (x - half, y - half, x + half, y + half)


def test_anchor_adopts_smooths_and_snaps(spark):
    out = anchor(spark, [None, square(100.0), square(104.0), square(400.0)])
    assert out[0].x is None
    assert (out[1].x, out[1].radius) == (100.0, pytest.approx(40 * 0.62))
    assert 100 < out[2].x < 104 and out[2].vx > 0
    assert out[3].x == 400.0 and out[3].vx == 0.0


def test_anchor_coasts_then_holds(spark):
    out = anchor(spark, [square(100.0), square(120.0), *[None] * 40])
    xs = [r.x for r in out]
    assert xs[2] > xs[1] and xs[3] > xs[2] and xs[3] - xs[2] < xs[2] - xs[1] + 1e9
    assert xs[-1] == xs[-5] and out[-1].vx == 0.0


def test_moving_average_keeps_on_null(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, None), (1, 2, 2, 1.0)], "session long, frame long, ts long, v double")
    out = [r.average for r in blocks.moving_average(df, "v").orderBy("frame").collect()]
    assert out == pytest.approx([0.3, 0.3, 0.51])


def test_envelope(spark):
    ages = [-0.1, 0.0, 0.09, 1.0, 4.775, 5.0, 5.1]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    out = [r[0] for r in df.select(fx.envelope(F.col("age"), F.lit(5.0), F.lit(0.45), 0.18)).collect()]
    assert out == pytest.approx([0, 0, 0.5, 1, 0.5, 0, 0])
    start = [r[0] for r in df.select(fx.envelope(F.col("age"), F.lit(5.0), F.lit(0.45))).collect()]
    assert start[:2] == [0, 1]


def test_ramps_rise(spark):
    for stops in fx.RAMPS.values():
        levels = spark.range(256).select(F.col("id").alias("level"), (F.col("id") / 255.0).alias("t"))
        rows = fx.ramp_colours(levels, stops, ["level"], "t").orderBy("level").collect()
        assert len(rows) == 256 and tuple(rows[0])[1:] == (0, 0, 0) and tuple(rows[-1])[1:] == (255, 255, 255)
        sums = [sum(tuple(r)[1:]) for r in rows]
        assert sums == sorted(sums)


def test_aim_mirrors(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (3.0,)], "yaw double")
    out = [r[0] for r in df.select(fx.aim(F.col("yaw"), 1.15)).collect()]
    assert out == pytest.approx([0.575, math.pi - 0.575, 0.0, 0.575])


def test_cards_that_fit(spark):
    cards = F.array(*map(F.lit, "abcdef"))
    out = spark.range(1).select(fx.visible_cards(cards, F.lit(300)).alias("n"), fx.visible_cards(cards, F.lit(10)).alias("one"), fx.visible_cards(F.array().cast("array<string>"), F.lit(900)).alias("none")).first()
    assert (out.n, out.one, out.none) == (["e", "f"], ["f"], [])


def test_effects_of_patterns(spark):
    assert fx.effect_table(spark).count() == 7
