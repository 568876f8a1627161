"""Sequence functions over sessions without end: a session is cut into blocks that are worked on apart.

Rows are numbered in the order of session, time and frame without a total sort in one task, and a block is a run of
numbers. What reaches back a few frames (votes in a window, rates) gets those frames of the block before carried along
(a halo). What reaches back without bound is composed: each block tells its effect, effects are scanned over blocks, and
a block starts from what the scan gives it. No task holds more than a block with its halo, whatever the sessions are.

A null session is a session like any other; frames and times that are null come first, as Spark sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ordered_index
from .sequences import ORDER, Smoothing

#: Rows of a block.
BLOCK = 65_536
#: Rows that are scanned together, a power of two.
SCAN = 1024


def blocked(frames: DataFrame, block: int) -> DataFrame:
    """Rows with index (their place in the order of session, time, frame) and block."""
    placed = ordered_index(frames, "session", *ORDER)
    return placed.withColumn("block", F.floor(F.col("index") / block).cast("long"))


def with_halo(placed: DataFrame, block: int, before: int) -> DataFrame:
    """Each block with the last `before` rows of the block before, marked as halo. before: a block's rows at most."""
    if not 0 <= before <= block:
        raise ValueError("a halo is at most a block")
    late = F.col("index") % block >= block - before
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = placed.withColumn("__next", F.explode(copies))
    return out.withColumn("block", F.col("block") + F.col("__next")).withColumn("halo", F.col("__next") == 1).drop("__next")


def in_block() -> object:
    """One partitioning and order for all window functions of a block."""
    return Window.partitionBy("block", "session").orderBy("index")


def last_known(placed: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the last value that isn't null at or before each row of a session, and, as out_before, before its block.

    A block tells the last of its sessions; those are few beside the rows, and are scanned by block.
    """
    by = in_block()
    told = placed.filter(F.col(value).isNotNull()).groupBy("session", "block").agg(F.max_by(value, "index").alias("__told"))
    spans = placed.select("session", "block").distinct().join(told.withColumnRenamed("session", "__session").withColumnRenamed("block", "__at"), F.col("session").eqNullSafe(F.col("__session")) & (F.col("block") == F.col("__at")), "left")
    past = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("session").alias("__session"), F.col("block").alias("__at"), F.last("__told", ignorenulls=True).over(past).alias(f"{out}_before"))
    joined = placed.join(carried, F.col("session").eqNullSafe(F.col("__session")) & (F.col("block") == F.col("__at")), "left").drop("__session", "__at")
    own = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, F.coalesce(own, F.col(f"{out}_before")))


def smooth_blocks(frames: DataFrame, s: Smoothing = Smoothing(), block: int = BLOCK) -> DataFrame:
    """sequences.smooth for sessions of any length: adds held, emitted and stability, and index."""
    near = with_halo(blocked(frames, block), block, s.window - 1)
    recent = F.collect_list(F.struct("sign")).over(in_block().rowsBetween(-(s.window - 1), 0))
    w = near.withColumn("__w", recent).filter(~F.col("halo")).withColumn("__s", F.transform("__w", lambda x: x["sign"]))
    votes_for = lambda c: F.size(F.filter(F.col("__s"), lambda x: x.eqNullSafe(c)))
    signs = F.array_distinct(F.filter(F.col("__s"), lambda x: x.isNotNull()))
    best = F.array_max(F.transform(signs, lambda c, i: F.struct(votes_for(c).alias("votes"), (-i).alias("early"), c.alias("sign"))))
    enough = F.coalesce(F.col("__best.votes") >= s.min_votes, F.lit(False))
    missing = F.size(F.filter(F.col("__s"), lambda x: x.isNull()))
    acted = w.withColumn("__best", best).withColumn("__enough", enough)
    acted = acted.withColumn("__action", F.when(F.col("__enough"), F.col("__best.sign")).when(missing >= s.clear, ""))
    known = last_known(acted.drop("__w", "__best", "halo"), "__action", "__held")
    before = F.coalesce(F.lag("__held").over(in_block()), F.col("__held_before"))
    held = F.nullif(F.col("__held"), F.lit(""))
    stability = F.coalesce(F.when(F.col("held").isNotNull(), votes_for(F.col("held")) / s.window), F.lit(0.0))
    return (
        known.withColumn("__past", F.nullif(before, F.lit("")))
        .withColumn("held", held)
        .withColumn("emitted", F.when(F.col("__enough") & ~F.col("held").eqNullSafe(F.col("__past")), F.col("held")))
        .withColumn("stability", stability)
        .drop("__s", "__enough", "__action", "__held", "__held_before", "__past", "block")
    )


def rolling_rate_blocks(frames: DataFrame, last: int = 30, block: int = BLOCK) -> DataFrame:
    """sequences.rolling_rate for sessions of any length: adds fps and index."""
    near = with_halo(blocked(frames, block), block, last)
    by = in_block()
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by))) / 1e6
    recent = by.rowsBetween(-(last - 1), 0)
    rated = near.withColumn("__gap", gap).withColumn("fps", F.count("__gap").over(recent) / F.greatest(F.sum("__gap").over(recent), F.lit(1e-6)))
    return rated.filter(~F.col("halo")).drop("__gap", "halo", "block")


def scan_maps(rows: DataFrame, by: list[str], at: str, size: int) -> DataFrame:
    """Composes y -> a * y + b over the first rows of each group of `size` at most, up to each row: columns a and b.

    In log2(size) steps each row takes in the map that ends 1, 2, 4 and so on rows before it; all steps share one
    exchange and one sort.
    """
    w, reach = Window.partitionBy(*by).orderBy(at), 1
    while reach < size:
        past_a, past_b = F.lag("a", reach, 1.0).over(w), F.lag("b", reach, 0.0).over(w)
        rows = rows.withColumns({"__a": past_a, "__b": past_b})
        rows = rows.withColumns({"b": F.col("a") * F.col("__b") + F.col("b"), "a": F.col("a") * F.col("__a")}).drop("__a", "__b")
        reach *= 2
    return rows


def prefix_maps(rows: DataFrame, last: int, size: int = SCAN) -> DataFrame:
    """Rows with session, index (0 to last over all) and a, b of the row's own map: a and b of all its session's maps up to it.

    Blocks are scanned apart, and the maps of whole blocks by the same function, so that no level is one task.
    """
    cut = rows.withColumn("__block", F.floor(F.col("index") / size).cast("long"))
    inside = scan_maps(cut, ["session", "__block"], "index", size)
    if last < size:
        return inside.drop("__block")
    inside = inside.checkpoint()
    whole = inside.groupBy("session", "__block").agg(F.max_by("a", "index").alias("a"), F.max_by("b", "index").alias("b"))
    upper = prefix_maps(whole.withColumnRenamed("__block", "index"), last // size, size)
    carried = upper.select(F.col("session").alias("__s"), (F.col("index") + 1).alias("__b"), F.col("a").alias("__pa"), F.col("b").alias("__pb"))
    joined = inside.join(carried, F.col("session").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    a, b = F.coalesce("__pa", F.lit(1.0)), F.coalesce("__pb", F.lit(0.0))
    return joined.withColumns({"b": F.col("a") * b + F.col("b"), "a": F.col("a") * a}).drop("__block", "__s", "__b", "__pa", "__pb")


def moving_average(rows: DataFrame, value: str, rate: float = 0.3, start: float = 0.0, size: int = SCAN) -> DataFrame:
    """Rows with session, frame, ts: the average after each, a `rate` of the way to the value; null leaves it.

    The steps y -> (1 - rate) * y + rate * value are composed by a parallel scan, in built-in functions only.
    """
    v = F.col(value).cast("double")
    fed = rows.select("session", F.col("frame").cast("bigint").alias("frame"), "ts", v.alias("v"))
    placed = ordered_index(fed, "session", *ORDER)
    own = {"a": F.when(F.col("v").isNull(), F.lit(1.0)).otherwise(F.lit(1.0 - rate)), "b": F.coalesce(rate * F.col("v"), F.lit(0.0))}
    last = placed.agg(F.max("index")).first()[0]
    scanned = prefix_maps(placed.withColumns(own).drop("ts", "v"), -1 if last is None else last, size)
    average: Column = F.col("a") * F.lit(float(start)) + F.col("b")
    return scanned.select("session", "frame", average.alias("average"))
