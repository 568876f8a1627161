"""Model evaluation: metrics, parity of exports, decoding of raw outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import undo_letterbox
from .folds import fold_sorted


def top1(detections: DataFrame, frame: list[str], order: list[Column]) -> DataFrame:
    """The first detection of each frame in the given order."""
    ranked = detections.withColumn("__rank", F.row_number().over(Window.partitionBy(*frame).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def summarize(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each class: its metrics rounded to four places, null for a class that didn't appear.

    metrics has one row, with the arrays ap_class_index, ap50, ap, p, r that go together by position.
    """
    zipped = F.arrays_zip("ap_class_index", "ap50", "ap", "p", "r")
    each = metrics.select(F.inline(zipped)).select(
        F.col("ap_class_index").alias("class_id"),
        *[F.round(c, 4).alias(n) for c, n in (("ap50", "AP50"), ("ap", "AP50_95"), ("p", "precision"), ("r", "recall"))],
    )
    # as many rows as classes
    return names.join(F.broadcast(each), "class_id", "left")


def weakest(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.filter(F.col("AP50").isNotNull()).orderBy("AP50", "class_id").limit(n)


def implausible(score: Column, disjoint: Column, most: float = 0.97) -> Column:
    """A score this high on a disjoint split hints at a leak."""
    return disjoint & (score > most)


def parity(source: DataFrame, export: DataFrame) -> DataFrame:
    """One row: images, agreements in class (-1 without a detection) and the largest difference in confidence of those
    that both detect. Both have image, cls, conf."""
    a = source.select("image", F.col("cls").alias("ca"), F.col("conf").alias("fa"))
    b = export.select("image", F.col("cls").alias("cb"), F.col("conf").alias("fb"))
    same = F.coalesce("ca", F.lit(-1)) == F.coalesce("cb", F.lit(-1))
    return a.join(b, "image", "full").agg(
        F.count(F.lit(1)).alias("images"),
        F.sum(same.cast("bigint")).alias("agree"),
        F.coalesce(F.max(F.abs(F.col("fa") - F.col("fb"))), F.lit(0.0)).alias("max_delta"),
    )


def held_out_or_all(rows: DataFrame, source: str) -> DataFrame:
    """Rows of the source, or all if it has none."""
    any_held = rows.agg(F.coalesce(F.max(F.col("source") == source), F.lit(False)).alias("__any"))
    # one row
    joined = rows.join(F.broadcast(any_held))
    return joined.filter(~F.col("__any") | (F.col("source") == source)).drop("__any")


def decode_anchors(anchors: DataFrame, accept: float, scale: Column, pad_left: Column, pad_top: Column) -> DataFrame:
    """Of each image's anchors (image, anchor, cx, cy, w, h, scores) the most confident, in the original frame.

    Non-maximum suppression cannot remove it, so it isn't needed for the first detection.
    """
    conf = F.array_max("scores")
    scored = anchors.withColumns({"conf": conf, "cls": F.array_position("scores", conf).cast("int") - 1})
    best = top1(scored.filter(F.col("conf") >= accept), ["image"], [F.desc("conf"), F.col("anchor")])
    x1, y1 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    x2, y2 = F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2
    return best.select(
        "image",
        "anchor",
        "cls",
        "conf",
        undo_letterbox(x1, pad_left, scale).alias("x1"),
        undo_letterbox(y1, pad_top, scale).alias("y1"),
        undo_letterbox(x2, pad_left, scale).alias("x2"),
        undo_letterbox(y2, pad_top, scale).alias("y2"),
    )


def suppress(boxes: DataFrame, most: float = 0.7) -> DataFrame:
    """Non-maximum suppression: of an image's boxes (image, anchor, cls, conf, x1, y1, x2, y2) those that no kept box
    of their class, of higher confidence, overlaps by more than `most`. Of equal confidence the lower anchor is first.

    An image's boxes are at most a model's anchors, and are folded in order of confidence.
    """

    def step(kept: tuple, row: tuple) -> tuple[tuple, tuple]:
        _, image, anchor, cls, conf, x1, y1, x2, y2 = row
        area, stays = (x2 - x1) * (y2 - y1), True
        for c, a1, b1, a2, b2 in kept:
            if c == cls:
                both = max(0.0, min(x2, a2) - max(x1, a1)) * max(0.0, min(y2, b2) - max(y1, b1))
                union = area + (a2 - a1) * (b2 - b1) - both
                if union > 0 and both / union > most:
                    stays = False
                    break
        return ((*kept, (cls, x1, y1, x2, y2)) if stays else kept), (image, anchor, cls, conf, x1, y1, x2, y2, stays)

    names = ("x1", "y1", "x2", "y2")
    fed = boxes.select((-F.col("conf")).cast("double").alias("order"), "image", "anchor", "cls", F.col("conf").cast("double").alias("conf"), *[F.col(c).cast("double").alias(c) for c in names])
    kind = lambda c: fed.schema[c].dataType.simpleString()
    schema = f"image {kind('image')}, anchor {kind('anchor')}, cls {kind('cls')}, conf double, " + ", ".join(f"{c} double" for c in names) + ", stays boolean"
    return fold_sorted(fed, "image", ["order", "anchor"], (), step, schema).filter("stays").drop("stays")


def cache_mode(requested: Column, workers: Column, start_method: Column) -> Column:
    """ram is safe only without workers or with forked ones."""
    return F.when((requested != "ram") | (workers == 0) | (start_method == "fork"), requested).otherwise("disk")
