"""Stable signs from noisy frames, and ordered sequences matched over them.

Frames have session, frame (a unique number that breaks ties), ts (a timestamp) and sign (null when none was
detected). All window functions share one partitioning by session and one order, so a plan has one exchange and one
sort. The matcher folds a session's emissions, which are few beside its frames, one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .folds import fold_sorted
from .pattern_automaton import PatternAutomaton


@dataclass(frozen=True)
class Pattern:
    name: str
    signs: tuple[str, ...]
    element: str = ""


@dataclass(frozen=True)
class Smoothing:
    """Frames looked at, votes that confirm a sign, and missing frames that clear it (half of the window if None)."""

    window: int = 25
    min_votes: int = 18
    clear_votes: int | None = None

    def __post_init__(self):
        if self.min_votes > self.window or self.clear > self.window:
            raise ValueError("a threshold above the window cannot be reached")

    @property
    def clear(self) -> int:
        return max(1, self.window // 2) if self.clear_votes is None else self.clear_votes


def longest_first(patterns: list[Pattern]) -> list[Pattern]:
    return sorted(patterns, key=lambda p: -len(p.signs))


def vote_gate(sign: Column, confidence: Column, accept: float) -> Column:
    """A sign counts from this confidence on."""
    return F.when(confidence >= accept, sign)


ORDER = ("ts", "frame")


def smooth(frames: DataFrame, s: Smoothing = Smoothing()) -> DataFrame:
    """Adds held, emitted (a newly confirmed sign) and stability (share of the window that agrees with held).

    The sign with most votes in the window wins, of equals the one seen first in it. With votes enough it is held, and
    emitted if it wasn't; else enough missing frames clear what is held.
    """
    by = Window.partitionBy("session").orderBy(*ORDER)
    window = F.collect_list(F.struct("sign")).over(by.rowsBetween(-(s.window - 1), 0))
    w = F.transform(F.col("__w"), lambda x: x["sign"])
    votes_for = lambda c: F.size(F.filter(F.col("__s"), lambda x: x.eqNullSafe(c)))
    signs = F.array_distinct(F.filter(F.col("__s"), lambda x: x.isNotNull()))
    best = F.array_max(F.transform(signs, lambda c, i: F.struct(votes_for(c).alias("votes"), (-i).alias("early"), c.alias("sign"))))
    enough = F.col("__best.votes") >= s.min_votes
    missing = F.size(F.filter(F.col("__s"), lambda x: x.isNull()))
    action = F.when(enough, F.col("__best.sign")).when(missing >= s.clear, "")
    held = F.nullif(F.last("__action", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))
    emitted = F.when(F.coalesce(enough, F.lit(False)) & ~F.col("held").eqNullSafe(F.lag("held").over(by)), F.col("held"))
    stability = F.coalesce(F.when(F.col("held").isNotNull(), votes_for(F.col("held")) / s.window), F.lit(0.0))
    return (
        frames.withColumn("__w", window)
        .withColumn("__s", w)
        .withColumn("__best", best)
        .withColumn("__action", action)
        .withColumn("held", held)
        .withColumn("emitted", emitted)
        .withColumn("stability", stability)
        .drop("__w", "__s", "__best", "__action")
    )


def idle_clock(smoothed: DataFrame, timeout_s: float) -> DataFrame:
    """Adds idle_since (start of the run without a held sign), expired (the run is longer than the timeout) and
    expirations (frames so far that are)."""
    by = Window.partitionBy("session").orderBy(*ORDER)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("held").over(by)
    first = F.row_number().over(by) == 1
    start = F.when(F.col("held").isNull() & (before.isNotNull() | first), F.col("ts"))
    idle = F.when(F.col("held").isNull(), F.last("__start", ignorenulls=True).over(upto))
    elapsed = (F.unix_micros("ts") - F.unix_micros("idle_since")) / 1e6
    return (
        smoothed.withColumn("__start", start)
        .withColumn("idle_since", idle)
        .withColumn("idle_s", elapsed)
        .withColumn("expired", F.coalesce(F.col("idle_s") > timeout_s, F.lit(False)))
        .withColumn("expirations", F.sum(F.col("expired").cast("int")).over(upto))
        .drop("__start")
    )


def emissions(clocked: DataFrame, expires: bool = True) -> DataFrame:
    """The frames that emit, with reset: the buffer expired since the emission before."""
    by = Window.partitionBy("session").orderBy(*ORDER)
    out = clocked.filter(F.col("emitted").isNotNull())
    reset = F.col("expirations") > F.coalesce(F.lag("expirations").over(by), F.lit(0))
    return out.withColumn("reset", reset if expires else F.lit(False))


def automaton(patterns: list[Pattern], max_length: int = 16) -> PatternAutomaton:
    return PatternAutomaton([(p.name, p.signs) for p in longest_first(patterns)], max_length)


def fold_sequences(emitted: DataFrame, patterns: list[Pattern], max_length: int = 16, dedupe: bool = True) -> DataFrame:
    """Per emission in order: buffer after it, the pattern it completes with its length, and node, the automaton's.

    A sign is added to the buffer, which keeps the last `max_length`; the longest pattern that ends it matches and
    clears it. dedupe: a sign equal to the last in the buffer isn't added. A sign takes one transition of an automaton
    of all patterns, so the time doesn't depend on their number.
    """
    ship(emitted.sparkSession)
    sent = emitted.sparkSession.sparkContext.broadcast(automaton(patterns, max_length))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        session, frame, ts, sign, reset = row
        buffer, node = ((), 0) if reset else state
        found = None
        if not (dedupe and buffer and buffer[-1] == sign):
            known = sent.value
            buffer, node = (*buffer, sign)[-max_length:], known.step(node, sign)
            found = known.longest[node]
            if found:
                buffer, node = (), 0
        return (buffer, node), (session, frame, ts, sign, list(buffer), *(found or (None, None)), node)

    fed = emitted.select("session", F.col("frame").cast("bigint").alias("frame"), F.unix_micros("ts").alias("ts"), F.col("emitted").alias("sign"), "reset")
    kind = fed.schema["session"].dataType.simpleString()
    schema = f"session {kind}, frame bigint, ts bigint, sign string, buffer array<string>, pattern string, length int, node int"
    return fold_sorted(fed, "session", ["ts", "frame"], ((), 0), step, schema).withColumn("ts", F.timestamp_micros("ts"))


def trace(frames: DataFrame, patterns: list[Pattern], s: Smoothing, timeout_s: float = 3.0, max_length: int = 16) -> DataFrame:
    """Per emission: session, frame, ts, sign, buffer, pattern, length, node."""
    clocked = idle_clock(smooth(frames, s), timeout_s)
    return fold_sequences(emissions(clocked), patterns, max_length)


def idle_expiries(frames: DataFrame, patterns: list[Pattern], s: Smoothing, timeout_s: float, max_length: int = 16) -> DataFrame:
    """When buffers expire by a clock that needs no frame: session, idle_since, at (a timeout later), signs.

    A sign is let go at the first frame without a held one; if none is held again within the timeout, what is in the
    buffer expires, also where no frame follows.
    """
    by = Window.partitionBy("session").orderBy(*ORDER)
    smoothed = smooth(frames, s)
    first = F.row_number().over(by) == 1
    let_go = smoothed.withColumn("__start", F.when(F.col("held").isNull() & (F.lag("held").over(by).isNotNull() | first), F.unix_micros("ts")))
    events = let_go.filter(F.col("emitted").isNotNull() | F.col("__start").isNotNull())
    # between two emissions a sign is let go once at most
    since = F.when(F.col("emitted").isNotNull(), F.lag("__start").over(by))
    timeout = round(timeout_s * 1e6)
    told = events.withColumn("reset", F.coalesce(F.unix_micros("ts") - since > timeout, F.lit(False)))
    told = told.withColumn("__idle", F.lead("__start").over(by)).withColumn("__next", F.lead(F.unix_micros("ts"), 2).over(by))
    emitted = told.filter(F.col("emitted").isNotNull())
    folded = fold_sequences(emitted, patterns, max_length).select("session", "frame", F.size("buffer").alias("signs"))
    gone = F.col("__next").isNull() | (F.col("__next") - F.col("__idle") > timeout)
    ends = emitted.filter(F.col("__idle").isNotNull() & gone).select("session", "frame", "__idle")
    at = lambda c: F.timestamp_micros(c)
    return ends.join(folded.filter("signs > 0"), ["session", "frame"]).select("session", at(F.col("__idle")).alias("idle_since"), at(F.col("__idle") + timeout).alias("at"), "signs")


def match_sequences(frames: DataFrame, patterns: list[Pattern], s: Smoothing, timeout_s: float = 3.0, max_length: int = 16) -> DataFrame:
    return trace(frames, patterns, s, timeout_s, max_length).filter(F.col("pattern").isNotNull())


def frame_states(frames: DataFrame, patterns: list[Pattern], s: Smoothing, timeout_s: float = 3.0, hold_s: float = 3.0) -> DataFrame:
    """Per frame: held, buffered (signs in the buffer), time_left (null while the clock is off) and banner."""
    clocked = idle_clock(smooth(frames, s), timeout_s)
    told = fold_sequences(emissions(clocked), patterns).select(
        "session",
        "frame",
        F.size("buffer").alias("__size"),
        F.when(F.col("pattern").isNotNull(), F.struct(F.col("pattern"), F.col("ts").alias("at"))).alias("__match"),
    )
    by = Window.partitionBy("session").orderBy(*ORDER)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    joined = clocked.join(told, ["session", "frame"], "left")
    seen = F.last(F.when(F.col("__size").isNotNull(), F.struct("__size", "expirations")), ignorenulls=True).over(upto)
    last = F.last("__match", ignorenulls=True).over(upto)
    on = F.col("held").isNull() & (F.col("buffered") > 0)
    since = (F.unix_micros("ts") - F.unix_micros("__last.at")) / 1e6
    return (
        joined.withColumn("__seen", seen)
        .withColumn("__last", last)
        .withColumn(
            "buffered", F.when(F.col("__seen.expirations") == F.col("expirations"), F.col("__seen.__size")).otherwise(0)
        )
        .withColumn("time_left", F.when(on, F.greatest(F.lit(0.0), timeout_s - F.col("idle_s"))))
        .withColumn("banner", F.when(since <= hold_s, F.col("__last.pattern")))
        .drop("__seen", "__last", "__size", "__match")
    )


def progress(traced: DataFrame, patterns: list[Pattern], max_length: int = 16) -> DataFrame:
    """Per emission, the patterns that the buffer's end begins: pattern, depth, and rank by depth.

    The emission's node gives the prefixes that the buffer ends with, and each of those the patterns that it begins; a
    pattern counts with its longest. Both are small tables; their size is left to the optimizer.
    """
    spark, known = traced.sparkSession, automaton(patterns, max_length)
    ends = [(node, end, depth) for node in range(1, len(known.next)) for end, depth in known.ends(node)]
    begins = [(end, place, known.names[place]) for end, places in enumerate(known.begins) for place in places]
    chain = spark.createDataFrame(ends, "node int, __end int, depth int")
    begun = spark.createDataFrame(begins, "__end int, __place int, pattern string")
    met = traced.select("session", "frame", "node").join(chain, "node").join(begun, "__end")
    deepest = met.groupBy("session", "frame", "__place", "pattern").agg(F.max("depth").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("session", "frame").orderBy(F.desc("depth"), "__place")) - 1
    return deepest.select("session", "frame", rank.alias("rank"), "pattern", "depth")


def unreachable(patterns: DataFrame) -> DataFrame:
    """Patterns (name, signs, place) that a shorter one interrupts before they end: name, blocked_by, at.

    Patterns of equal signs are one, with the first in the table, so hot signs aren't paired with each other. The runs of
    signs inside each, which are few as patterns are short, meet those that are such runs by an equality, and what they
    find is joined to the patterns. Of several the first in the table counts, where it ends first.
    """
    firsts = patterns.groupBy("signs").agg(F.min(F.struct(F.col("place").alias("pi"), F.col("name").alias("blocked_by"))).alias("i"))
    ends = firsts.select("signs", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("signs") - 1))).alias("at")).filter(F.col("at") < F.size("signs"))
    runs = ends.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("at")))).select("signs", "at", F.slice("signs", F.col("at") - F.col("n") + 1, F.col("n")).alias("run"))
    met = runs.join(firsts.select(F.col("signs").alias("run"), "i"), "run")
    blocked = met.groupBy("signs").agg(F.min(F.struct("i.pi", "at", "i.blocked_by")).alias("m"))
    first = patterns.join(blocked, "signs").groupBy("name", "place").agg(F.min("m").alias("m"))
    return first.select("name", "m.blocked_by", "m.at")


def rolling_rate(frames: DataFrame, last: int = 30) -> DataFrame:
    """Adds fps: frames of the last `last` over the seconds between them, which count as a millionth at least."""
    by = Window.partitionBy("session").orderBy(*ORDER)
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by))) / 1e6
    recent = by.rowsBetween(-(last - 1), 0)
    return (
        frames.withColumn("__gap", gap)
        .withColumn("fps", F.count("__gap").over(recent) / F.greatest(F.sum("__gap").over(recent), F.lit(1e-6)))
        .drop("__gap")
    )
