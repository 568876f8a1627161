"""Head pose, and the timing, aim and colours of effects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import first_interval
from .geometry import clamp

# The effect of each pattern and its parameters.
SPECS: dict[str, dict] = {
    "Chidori": {"kind": "lightning", "duration": 5.0, "charge": 0.18, "fade": 0.45, "bolts": 15, "radius_scale": 1.0, "flash": 0.34},
    "Transformation Jutsu": {"kind": "transform", "duration": 6.0, "smoke_s": 0.55, "fade": 0.5, "scale": 1.3, "puffs": 16},
    "Clone Jutsu": {"kind": "clone", "duration": 6.0, "count": 6, "stagger": 0.13, "fade": 0.6, "spread": 0.155, "shrink": 0.17, "rise": 0.10, "smoke_s": 0.45},
    "Dragon Flame Jutsu": {"kind": "flame", "duration": 5.0, "charge": 0.30, "fade": 0.7, "yaw_swing": 1.15, "reach": 0.52},
    "Water Bullet Jutsu": {"kind": "water", "duration": 4.5, "fade": 0.5, "shots": 4, "interval": 0.42, "speed": 0.95, "yaw_swing": 1.15},
    "Earth Dragon Bullet": {"kind": "earth", "duration": 5.0, "lunge": 0.7, "fade": 0.7, "size": 0.34, "reach": 0.17, "yaw_swing": 1.15},
    "Vacuum Wave": {"kind": "wave", "duration": 4.0, "fade": 0.5, "blades": 6, "interval": 0.34, "speed": 1.15, "arc": 62.0, "yaw_swing": 1.15},
}
# Stops of the colour ramps, (position, (blue, green, red)).
RAMPS = {
    "fire": (
        (0.00, (0, 0, 0)), (0.10, (0, 6, 90)), (0.22, (0, 40, 200)), (0.38, (15, 115, 250)), (0.55, (55, 185, 255)),
        (0.72, (130, 230, 255)), (0.88, (210, 250, 255)), (1.00, (255, 255, 255)),
    ),
    "water": (
        (0.00, (0, 0, 0)), (0.16, (70, 12, 0)), (0.34, (160, 55, 6)), (0.54, (225, 120, 30)), (0.74, (255, 200, 120)),
        (1.00, (255, 255, 255)),
    ),
}


def effect_table(spark: SparkSession) -> DataFrame:
    """name, kind, duration and the other parameters of each effect."""
    rows = [(n, s["kind"], s["duration"], {k: float(v) for k, v in s.items() if k != "kind"}) for n, s in SPECS.items()]
    return spark.createDataFrame(rows, "name string, kind string, duration double, params map<string,double>")


def envelope(age: Column, duration: Column, fade: Column, rise: Column | float = 0.0) -> Column:
    """0 outside [0, duration], a linear rise and fade, 1 between. Without a rise it starts at 1."""
    rise = rise if isinstance(rise, Column) else F.lit(float(rise))
    up = age / F.nullif(rise, F.lit(0.0))
    return (
        F.when((age < 0) | (age > duration), 0.0)
        .when(age < rise, up)
        .when(age > duration - fade, F.greatest(F.lit(0.0), (duration - age) / fade))
        .otherwise(1.0)
    )


def sprite_alpha(age: Column, duration: float, fade: float, smoke_s: float) -> Column:
    ramp = (age - smoke_s * 0.55) / max(smoke_s * 0.45, 1e-6)
    return (
        F.when(age < smoke_s * 0.55, 0.0)
        .when(age > duration - fade, F.greatest(F.lit(0.0), (duration - age) / fade))
        .otherwise(F.least(F.lit(1.0), ramp))
    )


def smoke_alpha(age: Column, smoke_s: float) -> Column:
    # at the end of the puff the sine may come out below zero by rounding
    wave = F.greatest(F.lit(0.0), F.sin(math.pi * F.least(F.lit(1.0), age / smoke_s)))
    return F.when((age < 0) | (age > smoke_s), 0.0).otherwise(F.pow(wave, 0.6))


def clone_alpha(index: Column, age: Column, duration: float, fade: float, stagger: float, smoke_s: float) -> Column:
    start = index * stagger
    return (
        F.when(age < start, 0.0)
        .when(age > duration - fade, F.greatest(F.lit(0.0), (duration - age) / fade))
        .otherwise(F.least(F.lit(1.0), (age - start) / max(smoke_s * 0.5, 1e-6)))
    )


def clone_placements(count: Column, shrink: float) -> Column:
    """array of (depth, side, scale, index) of the copies, far ones first."""
    depth = lambda i: F.floor(i / 2).cast("int") + 1
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((-depth(i)).alias("far"), i.alias("index")))
    return F.transform(
        F.array_sort(each),
        lambda c: F.struct(
            (-c["far"]).alias("depth"),
            F.when(c["index"] % 2 == 0, -1.0).otherwise(1.0).alias("side"),
            F.greatest(F.lit(0.25), 1.0 + shrink * c["far"]).alias("scale"),
            c["index"].alias("index"),
        ),
    )


def extent(age: Column, lunge: float) -> Column:
    """Smoothstep from 0 to 1 over the lunge."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), age) / max(lunge, 1e-6))
    return t * t * (3 - 2 * t)


def head_pose(mouth_x: Column, mouth_y: Column, width: Column, yaw: Column, grow: Column, spec: dict) -> Column:
    flip = F.when(yaw >= 0, 1.0).otherwise(-1.0)
    scale = spec["size"] * width * (0.30 + 0.70 * grow)
    return F.struct(
        (mouth_x + spec["reach"] * width * grow * flip).alias("x"),
        (mouth_y + scale * 0.30).alias("y"),
        (yaw * spec["yaw_swing"] * 0.28).alias("angle"),
        scale.alias("scale"),
        flip.alias("flip"),
    )


def place(x: Column, y: Column, pose: Column) -> Column:
    """A point of the head, turned, scaled and moved into the frame."""
    fx = x * pose["flip"]
    cos, sin = F.cos(pose["angle"]), F.sin(pose["angle"])
    return F.struct(
        (pose["x"] + (fx * cos - y * sin) * pose["scale"]).alias("x"),
        (pose["y"] + (fx * sin + y * cos) * pose["scale"]).alias("y"),
    )


def aim(yaw: Column, swing: float) -> Column:
    """Radians; 0 points right, pi left."""
    turn = clamp(yaw, -1.0, 1.0)
    return F.when(turn >= 0, turn * swing * 0.5).otherwise(math.pi - F.abs(turn) * swing * 0.5)


def shots_due(age: Column, shots: int, interval: float) -> Column:
    """How many of a volley have been fired: shot i is due at i times the interval."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(shots - 1)), lambda i: age >= i * interval))


def blades_in_flight(age: Column, blades: int, interval: float, speed: float) -> Column:
    """array of (travel, index) of the blades that are launched and not spent."""
    each = F.transform(
        F.sequence(F.lit(0), F.lit(blades - 1)),
        lambda i: F.struct(((age - i * interval) * speed).alias("travel"), i.alias("index")),
    )
    return F.filter(each, lambda b: (age >= b["index"] * interval) & (b["travel"] <= 1.35))


def ramp_colours(levels: DataFrame, stops: tuple, key: list[str], at: str) -> DataFrame:
    """key, blue, green, red of positions from 0 to 1 on a ramp: a join with the first interval of stops that holds each."""
    held = [(k, *map(float, (a, b)), *ca, *cb) for k, ((a, ca), (b, cb)) in enumerate(zip(stops, stops[1:], strict=False))]
    names = "k int, t0 double, t1 double, b0 int, g0 int, r0 int, b1 int, g1 int, r1 int"
    intervals = levels.sparkSession.createDataFrame(held, names)
    met = first_interval(levels, intervals, key, at, "t0", "t1", ["k"])
    share = (F.col(at) - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6))
    mixed = lambda c: (F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share).cast("int")
    return met.select(*key, mixed("b").alias("blue"), mixed("g").alias("green"), mixed("r").alias("red"))


def estimate_yaw(keypoints: Column) -> Column:
    """Head yaw in [-1, 1] from points with x, y, conf: nose, eyes, ears. Null if one of the first three is unsure."""
    nose, left, right = (F.get(keypoints, F.lit(i)) for i in range(3))
    left_ear, right_ear = F.get(keypoints, F.lit(3)), F.get(keypoints, F.lit(4))
    span = F.abs(left["x"] - right["x"])
    raw = (nose["x"] - (left["x"] + right["x"]) / 2) / (span / 2)
    turned = (
        F.when((left_ear["conf"] < 0.3) & (right_ear["conf"] >= 0.3), F.greatest(raw, F.lit(0.35)))
        .when((right_ear["conf"] < 0.3) & (left_ear["conf"] >= 0.3), F.least(raw, F.lit(-0.35)))
        .otherwise(raw)
    )
    sure = (nose["conf"] >= 0.3) & (left["conf"] >= 0.3) & (right["conf"] >= 0.3) & (span >= 3)
    return F.when(sure, clamp(turned, -1.0, 1.0))


def mouth_box(keypoints: Column, width: Column, scale: Column) -> Column:
    """Box around the mouth, below the nose by the distance of the eyes; null if the nose is unsure."""
    nose, left, right = (F.get(keypoints, F.lit(i)) for i in range(3))
    eyes = F.hypot(left["x"] - right["x"], left["y"] - right["y"])
    gap = F.when(eyes > 4, eyes).otherwise(width * 0.05)
    x, y = nose["x"] * scale, (nose["y"] + gap * 0.55) * scale
    r = F.greatest(F.lit(8.0), gap * scale)
    found = F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2"))
    return F.when(nose["conf"] > 0.4, found)


def visible_cards(cards: Column, width: Column) -> Column:
    """The last cards that fit: one for each 116 pixels beside a margin of 40, one at least."""
    n = F.greatest(F.lit(1), F.floor((width - 40) / 116)).cast("int")
    return F.slice(cards, F.greatest(F.lit(1), F.size(cards) - n + 1), n)


def ease_out_cubic(age: Column, grow_s: float) -> Column:
    """Growth from 0 to 1 over grow_s, fast at first."""
    left = 1 - clamp(age / grow_s, 0.0, 1.0)
    return 1 - left * left * left


def timer_fraction(left_s: Column, timeout_s: Column) -> Column:
    """Share of the timeout that is left."""
    return clamp(left_s / F.greatest(timeout_s, F.lit(1e-6)), 0.0, 1.0)
