"""Folds over a session's boxes: the anchor that follows them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_sorted


@dataclass(frozen=True)
class Anchor:
    smoothing: float = 0.45
    snap_distance: float = 160.0
    coast_s: float = 0.6
    damping: float = 0.85


def follower(a: Anchor):
    """step(state, now, box) for events in order; state is x, y, radius, w, h, vx, vy, seen, at.

    The first box is adopted, a jump snaps. Else the step grows with the distance, from `smoothing` to 0.95. Without a
    box the anchor coasts on its slowing velocity for `coast_s`, then stays.
    """
    smoothing, snap, coast_s, damping = a.smoothing, a.snap_distance, a.coast_s, a.damping

    def step(state: tuple, now: float, box: dict | None) -> tuple:
        x, y, radius, w, h, vx, vy, seen, at = state
        if box is None:
            if x is None:
                return (*state[:8], now)
            dt = max(0.0, now - at)
            if now - seen <= coast_s and dt > 0:
                return x + vx * dt, y + vy * dt, radius, w, h, vx * damping, vy * damping, seen, now
            return x, y, radius, w, h, 0.0, 0.0, seen, now
        tx, ty = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
        tw, th = box["x2"] - box["x1"], box["y2"] - box["y1"]
        tr = max(tw, th) * 0.62
        if x is not None:
            far = ((tx - x) * (tx - x) + (ty - y) * (ty - y)) ** 0.5
            if far <= snap:
                k = smoothing + (0.95 - smoothing) * min(1.0, far / max(snap, 1e-6))
                dt = max(0.0, now - at)
                nx, ny = x + (tx - x) * k, y + (ty - y) * k
                if dt > 1e-4:
                    vx, vy = (nx - x) / dt, (ny - y) / dt
                return nx, ny, radius + (tr - radius) * k, w + (tw - w) * k, h + (th - h) * k, vx, vy, now, now
        return tx, ty, tr, tw, th, 0.0, 0.0, now, now

    return step


FIELDS = ("x", "y", "radius", "w", "h", "vx", "vy")


def track_anchor(boxes: DataFrame, a: Anchor = Anchor()) -> DataFrame:
    """Rows with session, frame, ts (seconds) and box (x1, y1, x2, y2 or null): the anchor after each; null before any box."""
    follow = follower(a)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        session, frame, ts, box = row
        state = follow(state, ts, box)
        return state, (session, frame, *state[:7])

    fed = boxes.select("session", F.col("frame").cast("bigint").alias("frame"), F.col("ts").cast("double").alias("ts"), "box")
    schema = f"session {fed.schema['session'].dataType.simpleString()}, frame bigint, " + ", ".join(f"{c} double" for c in FIELDS)
    return fold_sorted(fed, "session", ["ts", "frame"], (None,) * 9, step, schema)
