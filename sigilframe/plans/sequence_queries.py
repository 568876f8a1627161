"""Queries over the stream of frames: votes, smoothing, sequences, tracking.

events stand for frames: a user's session, the type as sign, the value as confidence. Their gaps are hours, so the
timeout is a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import effects as fx
from ..functions.vocabulary import NAMES
from ..operators import blocks, evaluation, sequences, tracking
from ..operators.sequences import Pattern, Smoothing
from ..session import table
from ..sources.patterns import parse_pattern_lines
from .literals import sql_value, sql_values

ACCEPT, DAY, HOLD_S = 20.0, 86400.0, 43200.0
SMOOTHING = Smoothing(3, 2, 2)
PATTERNS = [
    Pattern("browse to buy", ("view", "click", "purchase")),
    Pattern("broken click", ("click", "error")),
    Pattern("new viewer", ("signup", "view")),
    Pattern("recovered buyer", ("error", "purchase", "click", "view")),
]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("frame"),
        F.col("ts").cast("timestamp").alias("ts"),
        sequences.vote_gate(F.col("event_type"), F.col("value"), ACCEPT).alias("sign"),
    )


TYPES = ("view", "click", "purchase", "signup", "error")
SMOOTHED = f"""
f AS (SELECT user_id AS session, event_id AS frame, ts, CASE WHEN value >= 20 THEN event_type END AS sign FROM events),
v AS (SELECT *, CASE {' '.join(f"WHEN count(*) FILTER (sign = '{t}') OVER w >= 2 THEN '{t}'" for t in TYPES)} END AS top,
             count(*) FILTER (sign IS NULL) OVER w AS nulls, list(sign) OVER w AS win
      FROM f WINDOW w AS (PARTITION BY session ORDER BY ts, frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, CASE WHEN top IS NOT NULL THEN top WHEN nulls >= 2 THEN '' END AS action FROM v),
h AS (SELECT *, nullif(last_value(action IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, frame ROWS UNBOUNDED PRECEDING), '') AS held FROM a),
e AS (SELECT *, CASE WHEN top IS NOT NULL AND held IS DISTINCT FROM lag(held) OVER o THEN held END AS emitted,
             CASE WHEN held IS NULL AND (lag(held) OVER o IS NOT NULL OR row_number() OVER o = 1) THEN ts END AS st
      FROM h WINDOW o AS (PARTITION BY session ORDER BY ts, frame))
"""
CLOCKED = f"""{SMOOTHED},
c AS (SELECT *, CASE WHEN held IS NULL THEN last_value(st IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, frame ROWS UNBOUNDED PRECEDING) END AS idle_since FROM e),
x AS (SELECT *, (epoch_us(ts) - epoch_us(idle_since)) / 1e6 AS idle_s FROM c),
y AS (SELECT *, sum(CASE WHEN idle_s > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, frame ROWS UNBOUNDED PRECEDING) AS expirations FROM x),
em AS (SELECT session, frame, ts, emitted, expirations, row_number() OVER o AS k, expirations > coalesce(lag(expirations) OVER o, 0) AS reset
       FROM y WHERE emitted IS NOT NULL WINDOW o AS (PARTITION BY session ORDER BY ts, frame))
"""


def list_sql(signs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{s}'" for s in signs) + "]"


MATCH = " ".join(
    f"WHEN NOT skip AND b[-{len(p.signs)}:] = {list_sql(p.signs)} THEN '{p.name}'" for p in sequences.longest_first(PATTERNS)
)
#: The matcher, one emission of each session a step.
FOLDED = f"""{CLOCKED},
t AS (
    SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS sign,
           CAST([] AS VARCHAR[]) AS buffer, CAST(NULL AS VARCHAR) AS pattern, CAST(0 AS HUGEINT) AS expirations FROM (SELECT DISTINCT session FROM em)
    UNION ALL
    SELECT session, k, frame, ts, sign, CASE WHEN pattern IS NULL THEN b ELSE [] END, pattern, expirations FROM (
        SELECT *, CASE {MATCH} END AS pattern FROM (
            SELECT session, k, frame, ts, sign, skip, expirations, CASE WHEN skip THEN b0 ELSE list_append(b0, sign)[-16:] END AS b FROM (
                SELECT *, coalesce(b0[-1] = sign, FALSE) AS skip FROM (
                    SELECT em.session, em.k, em.frame, em.ts, em.emitted AS sign, CASE WHEN em.reset THEN [] ELSE t.buffer END AS b0, em.expirations
                    FROM t JOIN em ON em.session = t.session AND em.k = t.k + 1)))))
"""


def top1_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a frame; its most confident event, and whether it may vote."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("date"))
    best = evaluation.top1(e, ["user_id", "day"], [F.desc("value"), F.col("event_id")])
    vote = sequences.vote_gate(F.col("event_type"), F.col("value"), 60.0)
    return best.select("user_id", "day", "event_id", "event_type", F.round("value", 6).alias("confidence"), vote.alias("vote"))


def smooth_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = sequences.smooth(frames(spark, sf_dir), SMOOTHING)
    return smoothed.filter(F.col("emitted").isNotNull()).select("session", "frame", "emitted")


#: Two of five votes confirm, so that two signs may have as many.
TIES = Smoothing(5, 2, 4)


def smooth_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal votes the sign seen first in the window wins."""
    smoothed = sequences.smooth(frames(spark, sf_dir), TIES)
    return smoothed.filter(F.col("emitted").isNotNull()).select("session", "frame", "emitted", F.round("stability", 6).alias("stability"))


SMOOTH_TIES = f"""
WITH f AS (SELECT user_id AS session, event_id AS frame, ts, CASE WHEN value >= 20 THEN event_type END AS sign FROM events),
v AS (SELECT *, list(sign) OVER (PARTITION BY session ORDER BY ts, frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS win FROM f),
b AS (SELECT *, list_sort(list_filter([{', '.join(f"{{'c': len(list_filter(win, lambda x: x = '{t}')), 'e': -coalesce(list_position(win, '{t}'), 99), 's': '{t}'}}" for t in TYPES)}], lambda x: x.c > 0), 'DESC') AS top FROM v),
a AS (SELECT *, CASE WHEN top[1].c >= 2 THEN top[1].s WHEN len(list_filter(win, lambda x: x IS NULL)) >= 4 THEN '' END AS action,
             coalesce(top[1].c >= 2, FALSE) AS enough FROM b),
h AS (SELECT *, nullif(last_value(action IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, frame ROWS UNBOUNDED PRECEDING), '') AS held FROM a),
e AS (SELECT *, CASE WHEN enough AND held IS DISTINCT FROM lag(held) OVER (PARTITION BY session ORDER BY ts, frame) THEN held END AS emitted FROM h)
SELECT session, frame, emitted, round(len(list_filter(win, lambda x: x = held)) / 5.0::DOUBLE, 6) AS stability FROM e WHERE emitted IS NOT NULL
"""


def card_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as ages in hundredths of a second, and as seconds left of a minute."""
    e = table(spark, sf_dir, "events")
    grown, left = fx.ease_out_cubic(F.col("value") / 100, 0.22), fx.timer_fraction(F.col("value"), F.lit(60.0))
    size = lambda whole: F.floor(whole * (0.85 + 0.15 * grown)).cast("bigint")
    return e.select("event_id", F.round(grown, 6).alias("ease"), size(104).alias("width"), size(92).alias("height"), F.round(left, 6).alias("left"))


CARD_GROWTH = """
WITH g AS (SELECT event_id, value, 1 - pow(1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100 / 0.22::DOUBLE)), 3) AS ease FROM events)
SELECT event_id, round(ease, 6) AS ease, CAST(floor(104 * (0.85::DOUBLE + 0.15::DOUBLE * ease)) AS BIGINT) AS width,
       CAST(floor(92 * (0.85::DOUBLE + 0.15::DOUBLE * ease)) AS BIGINT) AS height, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 60.0::DOUBLE)), 6) AS "left" FROM g
"""


def sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = sequences.smooth(frames(spark, sf_dir), SMOOTHING)
    return smoothed.select("session", "frame", "held", F.round("stability", 6).alias("stability"))


def match_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.match_sequences(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY)
    return found.select("session", "frame", "pattern", "length")


def sequence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = sequences.trace(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY)
    return traced.select("session", "frame", "sign", F.array_join("buffer", ">").alias("buffer"), "pattern")


def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = sequences.frame_states(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY, HOLD_S)
    return states.select("session", "frame", F.col("buffered").cast("bigint").alias("buffered"), F.round("time_left", 6).alias("time_left"))


def match_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = sequences.frame_states(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY, HOLD_S)
    return states.filter(F.col("banner").isNotNull()).select("session", "frame", "banner")


STATES = f"""{FOLDED},
j AS (SELECT y.*, t.frame AS tf, t.expirations AS texp, len(t.buffer) AS size, t.pattern AS pat FROM y LEFT JOIN t ON t.session = y.session AND t.frame = y.frame),
s AS (SELECT *, last_value(CASE WHEN tf IS NOT NULL THEN size END IGNORE NULLS) OVER o AS last_size,
             last_value(CASE WHEN tf IS NOT NULL THEN texp END IGNORE NULLS) OVER o AS last_exp,
             last_value(pat IGNORE NULLS) OVER o AS last_pat, last_value(CASE WHEN pat IS NOT NULL THEN ts END IGNORE NULLS) OVER o AS last_at
      FROM j WINDOW o AS (PARTITION BY session ORDER BY ts, frame ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CASE WHEN last_exp = expirations THEN last_size ELSE 0 END AS buffered FROM s)
"""


def match_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = sequences.trace(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY)
    out = sequences.progress(traced, PATTERNS)
    return out.select("session", "frame", F.col("rank").cast("bigint").alias("rank"), "pattern", F.col("depth").cast("bigint").alias("depth"))


PROGRESS = f"""
WITH RECURSIVE {FOLDED},
p AS (SELECT * FROM {sql_values([(p.name, list(p.signs), i) for i, p in enumerate(sequences.longest_first(PATTERNS))], 'pattern, signs, i')}),
d AS (SELECT t.session, t.frame, p.pattern, p.i, max(n) AS depth FROM t, p, (SELECT unnest(range(1, 5)) AS n)
      WHERE t.k > 0 AND n <= len(p.signs) AND n <= len(t.buffer) AND p.signs[1:n] = t.buffer[-n:] GROUP BY ALL)
SELECT session, frame, row_number() OVER (PARTITION BY session, frame ORDER BY depth DESC, i) - 1 AS rank, pattern, depth FROM d
"""


def rolling_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = sequences.rolling_rate(frames(spark, sf_dir))
    return rated.select("session", "frame", F.round(F.col("fps") * 3600, 6).alias("per_hour"))


ROLLING_FPS = """
WITH g AS (SELECT user_id AS session, event_id AS frame, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT session, frame, round(count(gap) OVER w / greatest(coalesce(sum(gap) OVER w, 1e-6), 1e-6) * 3600, 6) AS per_hour
FROM g WINDOW w AS (PARTITION BY session ORDER BY ts, frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""

def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of patterns in which each user is a line: the first classes of their events, some in quotes, in capitals
    and with empty cells."""
    e = table(spark, sf_dir, "events")
    sign = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int"))
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter(F.col("k") <= 2 + F.col("user_id") % 4)
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", sign.alias("s")))), lambda x: F.when(x["k"] % 2 == 1, F.upper(x["s"])).otherwise(x["s"])), " , ")
    user = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit('"Jutsu, '), user, F.lit(' ""x"""'))).otherwise(F.concat(F.lit(" Jutsu "), user))
    line = F.concat(F.when(F.col("user_id") == 0, F.lit("\ufeff")).otherwise(""), F.lit("Style "), (F.col("user_id") % 5).cast("string"), F.lit(","), name, F.lit(","), F.col("signs"), F.lit(",,"))
    rows = first.groupBy("user_id").agg(signs.alias("signs"))
    return rows.select(F.col("user_id").cast("int").alias("place"), line.alias("line"))


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_pattern_lines(pattern_lines(spark, sf_dir), NAMES)
    return out.select("place", "name", "element", F.array_join("signs", ">").alias("signs"))


LINES = f"""
s AS (SELECT user_id, {sql_value(list(NAMES))}[event_id % {len(NAMES)} + 1] AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
n AS (SELECT user_id, string_agg(CASE WHEN k % 2 = 1 THEN upper(s) ELSE s END, ' , ' ORDER BY k) AS signs FROM s WHERE k <= 2 + user_id % 4 GROUP BY user_id),
g AS (SELECT CAST(user_id AS INTEGER) AS place, CASE WHEN user_id = 0 THEN chr(65279) ELSE '' END || 'Style ' || (user_id % 5) || ',' ||
             CASE WHEN user_id % 7 = 0 THEN '"Jutsu, ' || user_id || ' ""x""' || '"' ELSE ' Jutsu ' || user_id END || ',' || signs || ',,' AS line FROM n),
l AS (SELECT place, list_transform(regexp_extract_all(regexp_replace(line, '^\\x{{FEFF}}', '') || ',', '("(?:[^"]|"")*"|[^,]*),', 1),
             lambda c: trim(CASE WHEN c LIKE '"%"' THEN replace(c[2:-2], '""', '"') ELSE c END)) AS c FROM g),
p AS (SELECT place, c[2] AS name, c[1] AS element, list_transform(list_filter(c[3:], lambda x: x <> ''), lambda x: lower(x)) AS signs FROM l)
"""


def unreachable_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.unreachable(parse_pattern_lines(pattern_lines(spark, sf_dir), NAMES))
    return out.select("name", "blocked_by", F.col("at").cast("bigint").alias("at"))


UNREACHABLE = f"""
WITH {LINES},
m AS (SELECT o.name, o.place AS po, i.name AS blocked_by, i.place AS pi, min(k) AS "at"
      FROM p o, p i, (SELECT unnest(range(1, 8)) AS k)
      WHERE len(i.signs) < len(o.signs) AND k >= len(i.signs) AND k < len(o.signs) AND o.signs[k - len(i.signs) + 1:k] = i.signs GROUP BY ALL)
SELECT name, blocked_by, "at" FROM (SELECT *, row_number() OVER (PARTITION BY name, po ORDER BY pi) AS r FROM m) WHERE r = 1
"""


def tracked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box from each event, none for small values; a day of time is a second."""
    e = table(spark, sf_dir, "events")
    x, y = F.col("value"), (F.col("event_id") % 90).cast("double")
    w, h = (40 + F.col("user_id") % 30).cast("double"), (30 + F.col("event_id") % 40).cast("double")
    found = F.struct((x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1.7e9) / 86400
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), seconds.alias("ts"), F.when(F.col("value") >= 15, found).alias("box"))


def anchor_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracking.track_anchor(tracked_boxes(spark, sf_dir))
    return out.select("session", "frame", *[F.round(c, 9).alias(c) for c in ("x", "y", "radius", "w", "h", "vx", "vy")])


ANCHOR_TRACK = """
WITH RECURSIVE b AS (
    SELECT user_id AS session, event_id AS frame, (epoch_us(ts) / 1e6 - 1.7e9) / 86400 AS ts, value >= 15 AS has,
           value AS cx, CAST(event_id % 90 AS DOUBLE) AS cy, CAST(40 + user_id % 30 AS DOUBLE) AS bw, CAST(30 + event_id % 40 AS DOUBLE) AS bh,
           row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
m AS (SELECT session, frame, ts, k, has, ((cx - bw / 2) + (cx + bw / 2)) / 2 AS tx, ((cy - bh / 2) + (cy + bh / 2)) / 2 AS ty,
             (cx + bw / 2) - (cx - bw / 2) AS tw, (cy + bh / 2) - (cy - bh / 2) AS th FROM b),
t AS (
    SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS radius,
           CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS vx, CAST(NULL AS DOUBLE) AS vy, CAST(NULL AS DOUBLE) AS seen, CAST(NULL AS DOUBLE) AS at
    FROM (SELECT DISTINCT session FROM m)
    UNION ALL
    SELECT session, k, frame,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN tx WHEN 'move' THEN x + (tx - x) * a WHEN 'coast' THEN x + vx * dt ELSE x END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN ty WHEN 'move' THEN y + (ty - y) * a WHEN 'coast' THEN y + vy * dt ELSE y END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN greatest(tw, th) * 0.62 WHEN 'move' THEN radius + (greatest(tw, th) * 0.62 - radius) * a ELSE radius END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN tw WHEN 'move' THEN w + (tw - w) * a ELSE w END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN th WHEN 'move' THEN h + (th - h) * a ELSE h END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN 0 WHEN 'move' THEN CASE WHEN dt > 1e-4 THEN (x + (tx - x) * a - x) / dt ELSE vx END WHEN 'coast' THEN vx * 0.85 ELSE 0 END,
           CASE mode WHEN 'wait' THEN NULL WHEN 'adopt' THEN 0 WHEN 'move' THEN CASE WHEN dt > 1e-4 THEN (y + (ty - y) * a - y) / dt ELSE vy END WHEN 'coast' THEN vy * 0.85 ELSE 0 END,
           CASE WHEN mode = 'wait' THEN NULL WHEN has THEN ts ELSE seen END, ts
    FROM (SELECT *, 0.45::DOUBLE + (0.95::DOUBLE - 0.45::DOUBLE) * least(1.0, d / 160.0) AS a,
                 CASE WHEN has AND (x IS NULL OR d > 160.0) THEN 'adopt' WHEN has THEN 'move' WHEN x IS NULL THEN 'wait'
                      WHEN ts - seen <= 0.6 AND dt > 0 THEN 'coast' ELSE 'stay' END AS mode
          FROM (SELECT m.*, t.x, t.y, t.radius, t.w, t.h, t.vx, t.vy, t.seen, coalesce(greatest(0.0, m.ts - t.at), 0.0) AS dt,
                       sqrt((m.tx - t.x) * (m.tx - t.x) + (m.ty - t.y) * (m.ty - t.y)) AS d
                FROM t JOIN m ON m.session = t.session AND m.k = t.k + 1)))
SELECT session, frame, round(x, 9) AS x, round(y, 9) AS y, round(radius, 9) AS radius, round(w, 9) AS w, round(h, 9) AS h, round(vx, 9) AS vx, round(vy, 9) AS vy
FROM t WHERE k > 0
"""


def yaw_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    yaw = F.when(F.col("event_type") != "error", F.col("value") / 245 - 1)
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), yaw.alias("yaw"))
    out = blocks.moving_average(rows, "yaw")
    return out.select("session", "frame", F.round("average", 6).alias("yaw"))


YAW_EMA = """
WITH RECURSIVE b AS (SELECT user_id AS session, event_id AS frame, CASE WHEN event_type <> 'error' THEN value / 245 - 1 END AS v,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
t AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(0 AS DOUBLE) AS y FROM (SELECT DISTINCT session FROM b)
      UNION ALL SELECT b.session, b.k, b.frame, CASE WHEN v IS NULL THEN y ELSE y + (v - y) * 0.3::DOUBLE END FROM t JOIN b ON b.session = t.session AND b.k = t.k + 1)
SELECT session, frame, round(y, 6) AS yaw FROM t WHERE k > 0
"""


#: Lengths of patterns, and in how many places their signs may follow one another for them to be one.
RARE = {3: 2, 4: 6, 5: 1_000_000_000}


def found_patterns(spark: SparkSession, sf_dir: str) -> list[Pattern]:
    """Patterns that events themselves give: signs that are emitted one after another, the shorter the rarer. There are
    five signs, so these are some thousands at most."""
    emitted = sequences.smooth(frames(spark, sf_dir), SMOOTHING).filter(F.col("emitted").isNotNull())
    by = Window.partitionBy("session").orderBy("ts", "frame")
    told = None
    for n, most in RARE.items():
        last = F.collect_list("emitted").over(by.rowsBetween(-(n - 1), 0))
        runs = emitted.select(last.alias("signs")).filter(F.size("signs") == n)
        rare = runs.groupBy("signs").count().filter(F.col("count") <= most).select("signs")
        told = rare if told is None else told.unionByName(rare)
    return [Pattern(">".join(r["signs"]), tuple(r["signs"])) for r in told.orderBy("signs").collect()]


def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of patterns by the thousand."""
    out = sequences.match_sequences(frames(spark, sf_dir), found_patterns(spark, sf_dir), SMOOTHING, DAY)
    return out.select("session", "frame", "pattern", "length")


MANY_PATTERNS = f"""
WITH RECURSIVE {CLOCKED},
p AS ({' UNION ALL '.join(f"""SELECT {n} AS n, signs FROM (SELECT session, list(emitted) OVER (PARTITION BY session ORDER BY k ROWS {n - 1} PRECEDING) AS signs FROM em)
      WHERE len(signs) = {n} GROUP BY signs HAVING count(*) <= {most}""" for n, most in RARE.items())}),
l AS (SELECT {', '.join(f"coalesce(list(array_to_string(signs, '>')) FILTER (n = {n}), []) AS l{n}" for n in RARE)} FROM p),
t AS (
    SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST([] AS VARCHAR[]) AS buffer, CAST(NULL AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS pattern
    FROM (SELECT DISTINCT session FROM em)
    UNION ALL
    SELECT session, k, frame, CASE WHEN n IS NULL THEN b ELSE [] END, n, CASE WHEN n IS NOT NULL THEN array_to_string(b[-n:], '>') END FROM (
        SELECT session, k, frame, b, CASE {' '.join(f"WHEN NOT skip AND list_contains(l{n}, array_to_string(b[-{n}:], '>')) THEN {n}" for n in sorted(RARE, reverse=True))} END AS n FROM l, (
            SELECT session, k, frame, skip, CASE WHEN skip THEN b0 ELSE list_append(b0, sign)[-16:] END AS b FROM (
                SELECT *, coalesce(b0[-1] = sign, FALSE) AS skip FROM (
                    SELECT em.session, em.k, em.frame, em.emitted AS sign, CASE WHEN em.reset THEN [] ELSE t.buffer END AS b0
                    FROM t JOIN em ON em.session = t.session AND em.k = t.k + 1)))))
SELECT session, frame, pattern, n AS length FROM t WHERE n IS NOT NULL
"""


def visible_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.effects import visible_cards as last_cards

    traced = sequences.trace(frames(spark, sf_dir), PATTERNS, SMOOTHING, DAY)
    return traced.select("session", "frame", F.array_join(last_cards(F.col("buffer"), F.lit(300)), ">").alias("cards"))


def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of each session, and the frames between them."""
    smoothed = sequences.smooth(frames(spark, sf_dir), SMOOTHING)
    by = Window.partitionBy("session").orderBy("ts", "frame")
    at = smoothed.withColumn("i", F.row_number().over(by)).filter(F.col("emitted").isNotNull())
    gap = F.col("i") - F.lag("i").over(by)
    return at.withColumn("gap", gap).groupBy("session").agg(F.count(F.lit(1)).alias("emissions"), F.max("gap").cast("bigint").alias("longest_gap"))


QUERIES = {
    f.__name__: f
    for f in (
        top1_detection, smooth_signs, smooth_ties, card_growth, sign_stability, match_sequences, sequence_trace, time_left, match_banner, match_progress, rolling_fps,
        pattern_table, unreachable_patterns, anchor_track, yaw_ema, many_patterns, visible_cards, frame_gaps,
    )
}
ORACLES = {
    "smooth_ties": SMOOTH_TIES,
    "card_growth": CARD_GROWTH,
    "top1_detection": """
SELECT user_id, day, event_id, event_type, round(value, 6) AS confidence, CASE WHEN value >= 60 THEN event_type END AS vote
FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1""",
    "smooth_signs": f"WITH {SMOOTHED} SELECT session, frame, emitted FROM e WHERE emitted IS NOT NULL",
    "sign_stability": f"WITH {SMOOTHED} SELECT session, frame, held, CASE WHEN held IS NULL THEN 0.0::DOUBLE ELSE round(len(list_filter(win, lambda s: s = held)) / 3.0::DOUBLE, 6) END AS stability FROM e",
    "match_sequences": f"WITH RECURSIVE {FOLDED} SELECT session, frame, pattern, CAST(CASE pattern {' '.join(f"WHEN '{p.name}' THEN {len(p.signs)}" for p in PATTERNS)} END AS INTEGER) AS length FROM t WHERE pattern IS NOT NULL",
    "sequence_trace": f"WITH RECURSIVE {FOLDED} SELECT session, frame, sign, array_to_string(buffer, '>') AS buffer, pattern FROM t WHERE k > 0",
    "time_left": f"WITH RECURSIVE {STATES} SELECT session, frame, CAST(buffered AS BIGINT) AS buffered, CASE WHEN held IS NULL AND buffered > 0 THEN round(greatest(0.0, {DAY} - idle_s), 6) END AS time_left FROM z",
    "match_banner": f"WITH RECURSIVE {STATES} SELECT session, frame, last_pat AS banner FROM z WHERE (epoch_us(ts) - epoch_us(last_at)) / 1e6 <= {HOLD_S}",
    "match_progress": PROGRESS,
    "rolling_fps": ROLLING_FPS,
    "pattern_table": f"WITH {LINES} SELECT place, name, element, array_to_string(signs, '>') AS signs FROM p",
    "unreachable_patterns": UNREACHABLE,
    "anchor_track": ANCHOR_TRACK,
    "yaw_ema": YAW_EMA,
    "many_patterns": MANY_PATTERNS,
    "visible_cards": f"WITH RECURSIVE {FOLDED} SELECT session, frame, array_to_string(buffer[-2:], '>') AS cards FROM t WHERE k > 0",
    "frame_gaps": f"""WITH {SMOOTHED}, i AS (SELECT session, ts, frame, emitted, row_number() OVER (PARTITION BY session ORDER BY ts, frame) AS i FROM e),
g AS (SELECT session, i - lag(i) OVER (PARTITION BY session ORDER BY ts, frame) AS gap FROM i WHERE emitted IS NOT NULL)
SELECT session, count(*) AS emissions, CAST(max(gap) AS BIGINT) AS longest_gap FROM g GROUP BY session""",
}
