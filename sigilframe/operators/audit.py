"""Audits of sources by the geometry of their boxes: a source whose boxes are shaped or placed unlike all others' is
labelled wrongly as a whole, though each box alone looks right.

Distances are Kolmogorov's: the largest difference between a source's share of boxes up to a value and that of the
rest. They are exact from counts of distinct values, or within an error from mergeable quantile sketches, a few
kilobytes a source however many boxes it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import running_sum

#: Size of a sketch, which errs by a third of a percent in rank, and the quantiles at which two are compared.
SKETCH, PLACES = 1024, 400
#: What distances from sketches may differ by from exact ones of many rows: two ranks, and steps between quantiles.
SKETCH_ERROR = 0.03


def geometry_report(boxes: DataFrame, top: float = 0.4) -> DataFrame:
    """Per source of boxes (source, xc, yc, w, h): n, means of w, h, aspect and yc, and the share of centres above `top`.
    Boxes without an area aren't counted."""
    held = boxes.filter((F.col("w") > 0) & (F.col("h") > 0))
    return held.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("w").alias("w"),
        F.avg("h").alias("h"),
        F.avg(F.col("w") / F.col("h")).alias("aspect"),
        F.avg("yc").alias("yc"),
        F.avg((F.col("yc") < top).cast("double")).alias("top_share"),
    )


def distances(rows: DataFrame, value: str) -> DataFrame:
    """Per source: n and the exact distance of its values from those of all other sources; null where there is no other.

    Equal values are counted before anything is sorted, and sums run over ranges of values, so neither a source nor all
    values are one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy("source", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k")).checkpoint()
    own = running_sum(counts, ["source"], "v", "k", "upto")
    every = running_sum(counts.groupBy(F.lit(0).alias("one"), "v").agg(F.sum("k").alias("k_all")), ["one"], "v", "k_all", "upto_all")
    sizes = counts.groupBy("source").agg(F.sum("k").alias("n"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.sum("n").alias("n_all"))))
    met = own.join(every.drop("one"), "v").join(sizes, "source")
    others = F.col("n_all") - F.col("n")
    at = F.abs(F.col("upto") / F.col("n") - (F.col("upto_all") - F.col("upto")) / others)
    before_own, before_all = F.col("upto") - F.col("k"), F.col("upto_all") - F.col("k_all")
    before = F.abs(before_own / F.col("n") - (before_all - before_own) / others)
    # between a source's values only the rest's share grows, so it is farthest at one of them or just before
    return met.groupBy("source", "n").agg(F.max(F.when(others > 0, F.greatest(at, before))).alias("distance"))


def sketches(rows: DataFrame, value: str, size: int = SKETCH) -> DataFrame:
    """Per source a sketch of its values; sketches of parts of a source merge into one of the same size."""
    return rows.filter(F.col(value).isNotNull()).groupBy("source").agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def sketched_distances(held: DataFrame, places: int = PLACES) -> DataFrame:
    """distances within SKETCH_ERROR, from sketches of sources alone."""
    n = F.kll_sketch_get_n_double
    whole = held.agg(F.kll_merge_agg_double("sketch").alias("all"))
    both = held.join(F.broadcast(whole)).withColumn("n", n("sketch")).withColumn("n_all", n("all"))
    shares = F.array(*(F.lit((i + 0.5) / places) for i in range(places)))
    quantiles = lambda c: F.kll_sketch_get_quantile_double(c, shares)
    at = both.withColumn("own", quantiles("sketch")).withColumn("every", quantiles("all"))
    share = lambda c, v: F.size(F.filter(c, lambda x: x <= v)) / places
    others = F.col("n_all") - F.col("n")

    def apart(v: Column) -> Column:
        own = share("own", v)
        return F.abs(own - (share("every", v) * F.col("n_all") - own * F.col("n")) / others)

    looked = F.array_distinct(F.concat("own", "every"))
    return at.select("source", "n", F.when(others > 0, F.array_max(F.transform(looked, apart))).alias("distance"))

