"""Boxes and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.struct(xc.alias("xc"), yc.alias("yc"), w.alias("w"), h.alias("h"))


def recrop_box(b: Column, width: Column, height: Column, content: Column) -> Column:
    """A box relative to the frame, made relative to its content (left, top, right, bottom in pixels)."""
    crop_w, crop_h = content["right"] - content["left"], content["bottom"] - content["top"]
    return box(
        (b["xc"] * width - content["left"]) / crop_w,
        (b["yc"] * height - content["top"]) / crop_h,
        b["w"] * width / crop_w,
        b["h"] * height / crop_h,
    )


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def clip_box(b: Column) -> Column:
    """A box cut at the unit frame; one outside has no area."""
    x1, x2 = clamp(b["xc"] - b["w"] / 2), clamp(b["xc"] + b["w"] / 2)
    y1, y2 = clamp(b["yc"] - b["h"] / 2), clamp(b["yc"] + b["h"] / 2)
    return box((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)


def box_changed(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for f in ("xc", "yc", "w", "h"):
        out = out | (F.abs(before[f] - after[f]) > 1e-9)
    return out


def format_label(cls: Column, b: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, b["xc"], b["yc"], b["w"], b["h"])


def iou(a: Column, b: Column) -> Column:
    """Of two boxes with x1, y1, x2, y2; 0 if neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def letterbox(width: Column, height: Column, side: int = 640) -> Column:
    """How a frame is fitted centred into a square: scale, pad_left, pad_top."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    pad = lambda length: F.floor((side - F.round(length * scale)) / 2).cast("double")
    return F.struct(scale.alias("scale"), pad(width).alias("pad_left"), pad(height).alias("pad_top"))


def undo_letterbox(x: Column, pad: Column, scale: Column) -> Column:
    return (x - pad) / scale


def label_path(image: Column) -> Column:
    """Of an image: the last folder named images becomes labels, the suffix .txt."""
    return F.regexp_replace(image, r"^(.*/)images/((?!.*/images/).*)\.[^./]+$", "$1labels/$2.txt")


def listed_path(line: Column, parent: Column) -> Column:
    """./x stands beside the list it is in."""
    return F.when(line.startswith("./"), F.concat(parent, F.lit("/"), F.substring(line, 3, 1 << 30))).otherwise(line)
