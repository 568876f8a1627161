"""Queries over model outputs, poses and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import effects as fx
from ..functions import geometry as g
from ..functions.vocabulary import NAMES, class_table
from ..operators import evaluation, linkage
from ..operators.intervals import first_interval
from ..session import table
from .literals import sql_values

NAMES_SQL = sql_values(list(enumerate(NAMES)), "class_id, name")
#: Metrics of a class, by places in the vectors of its label.
PLACES = {"ap50": 0, "ap": 1, "p": 2, "r": 3}


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as classes: means over their vectors as metrics, in one row of arrays as evaluations give them."""
    e = table(spark, sf_dir, "embeddings")
    mean = {n: F.avg(F.abs(F.get("embedding", F.lit(i)).cast("double"))).alias(n) for n, i in PLACES.items()}
    each = e.groupBy(F.col("label").cast("int").alias("label")).agg(*mean.values())
    rows = each.agg(F.array_sort(F.collect_list(F.struct("label", *PLACES))).alias("a"))  # as many as classes
    given = rows.select(F.col("a.label").alias("ap_class_index"), *(F.col(f"a.{n}").alias(n) for n in PLACES))
    return evaluation.summarize(given, class_table(spark).select("class_id", "name"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


def weakest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.weakest(summary(spark, sf_dir)).select("name", "AP50")


METRICS_SQL = f"""
e AS (SELECT label AS class_id, {', '.join(f"round(avg(abs(embedding[{i + 1}]::DOUBLE)), 4) AS {n}" for n, i in PLACES.items())} FROM embeddings GROUP BY label),
m AS (SELECT n.class_id, n.name, ap50 AS "AP50", ap AS "AP50_95", p AS precision, r AS recall FROM {NAMES_SQL.replace(' AS v(', ' AS n(')} LEFT JOIN e USING (class_id))
"""


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the scores of an anchor: its first twelve numbers, in twentieths."""
    e = table(spark, sf_dir, "embeddings")
    score = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(F.round(x.cast("double") * 20) / 20))
    return e.select(
        (F.col("vec_id") % 40).alias("image"),
        F.col("vec_id").alias("anchor"),
        (F.col("vec_id") % 600 + 20).cast("double").alias("cx"),
        (F.col("vec_id") % 400 + 100).cast("double").alias("cy"),
        F.lit(64.0).alias("w"),
        F.lit(48.0).alias("h"),
        score.alias("scores"),
    )


def anchor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame is 1280 by 720, so it is halved and 140 rows lie above it."""
    fit = g.letterbox(F.lit(1280.0), F.lit(720.0))
    found = evaluation.decode_anchors(score_rows(spark, sf_dir), 0.05, fit["scale"], fit["pad_left"], fit["pad_top"])
    return found.select("image", "anchor", "cls", *[F.round(c, 6).alias(c) for c in ("conf", "x1", "y1", "x2", "y2")])


ANCHOR_DECODE = """
WITH s AS (SELECT vec_id % 40 AS image, vec_id AS anchor, vec_id % 600 + 20 AS cx, vec_id % 400 + 100 AS cy,
                  list_transform(embedding[1:12], lambda x: abs(round(x::DOUBLE * 20) / 20)) AS scores FROM embeddings),
c AS (SELECT *, list_max(scores) AS conf, list_position(scores, list_max(scores)) - 1 AS cls FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, anchor) AS r FROM c WHERE conf >= 0.05)
SELECT image, anchor, CAST(cls AS INTEGER) AS cls, round(conf, 6) AS conf, round((cx - 32) / 0.5::DOUBLE, 6) AS x1, round((cy - 24 - 140) / 0.5::DOUBLE, 6) AS y1,
       round((cx + 32) / 0.5::DOUBLE, 6) AS x2, round((cy + 24 - 140) / 0.5::DOUBLE, 6) AS y2 FROM b WHERE r = 1
"""


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of twelve vectors an image, in a grid that makes neighbours overlap."""
    rows = score_rows(spark, sf_dir).withColumns({"conf": F.array_max("scores"), "image": F.floor(F.col("anchor") / 12)})
    cls = F.array_position("scores", F.col("conf")).cast("int") % 3
    x, y = F.col("anchor") % 4 * 10, F.col("anchor") % 3 * 6
    side = lambda c: c.cast("double")
    boxes = rows.select("image", "anchor", cls.alias("cls"), "conf", side(x).alias("x1"), side(y).alias("y1"), side(x + 64).alias("x2"), side(y + 48).alias("y2"))
    return evaluation.suppress(boxes).select("image", "anchor", "cls", F.round("conf", 6).alias("conf"))


SUPPRESSED_BOXES = """
WITH RECURSIVE s AS (SELECT vec_id // 12 AS image, vec_id AS anchor, list_transform(embedding[1:12], lambda x: abs(round(x::DOUBLE * 20) / 20)) AS scores FROM embeddings),
c AS (SELECT image, anchor, list_max(scores) AS conf, list_position(scores, list_max(scores)) % 3 AS cls, anchor % 4 * 10 AS x, anchor % 3 * 6 AS y FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, anchor) AS k FROM c),
t AS (SELECT DISTINCT image, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(cls BIGINT, x BIGINT, y BIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS BIGINT) AS cls, CAST(NULL AS DOUBLE) AS conf, FALSE AS stays FROM b
      UNION ALL
      SELECT image, k, CASE WHEN stays THEN list_append(kept, {'cls': cls, 'x': x, 'y': y}) ELSE kept END, anchor, cls, conf, stays FROM (
          SELECT b.*, t.kept, len(list_filter(t.kept, lambda o: o.cls = b.cls AND greatest(0, 64 - abs(o.x - b.x)) * greatest(0, 48 - abs(o.y - b.y))
                 / (2.0::DOUBLE * 64 * 48 - greatest(0, 64 - abs(o.x - b.x)) * greatest(0, 48 - abs(o.y - b.y))) > 0.7)) = 0 AS stays
          FROM t JOIN b ON b.image = t.image AND b.k = t.k + 1))
SELECT image, anchor, CAST(cls AS INTEGER) AS cls, round(conf, 6) AS conf FROM t WHERE stays
"""


def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on all vectors of label 4 (all, if it had none) against a copy that is off in some."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("image"), F.col("label").cast("string").alias("source"), F.abs(F.col("embedding")[0].cast("double")).alias("x"))
    held = evaluation.held_out_or_all(rows, "4")
    a = held.filter("image % 7 <> 0").select("image", (F.col("image") % 12).cast("int").alias("cls"), "x").withColumnRenamed("x", "conf")
    b = held.filter("image % 5 <> 0").select(
        "image", F.when(F.col("image") % 11 == 0, 0).otherwise((F.col("image") % 12).cast("int")).alias("cls"), (F.col("x") + (F.col("image") % 3) / 1000).alias("conf")
    )
    return evaluation.parity(a, b).select("images", "agree", F.round("max_delta", 6).alias("max_delta"))


PARITY_CHECK = """
WITH r AS (SELECT vec_id AS image, CAST(label AS VARCHAR) AS source, abs(embedding[1]::DOUBLE) AS x FROM embeddings),
k AS (SELECT * FROM r WHERE source = '4' OR NOT EXISTS (SELECT 1 FROM r WHERE source = '4')),
a AS (SELECT image, image % 12 AS cls, x AS conf FROM k WHERE image % 7 <> 0),
b AS (SELECT image, CASE WHEN image % 11 = 0 THEN 0 ELSE image % 12 END AS cls, x + (image % 3) / 1000::DOUBLE AS conf FROM k WHERE image % 5 <> 0)
SELECT count(*) AS images, CAST(sum(CASE WHEN coalesce(a.cls, -1) = coalesce(b.cls, -1) THEN 1 ELSE 0 END) AS BIGINT) AS agree,
       round(coalesce(max(abs(a.conf - b.conf)), 0.0), 6) AS max_delta FROM a FULL JOIN b ON a.image = b.image
"""


def held_out_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 20 vectors of the held-out label, in an order that a seed fixes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("source"))
    held = evaluation.held_out_or_all(e, "4").withColumn("key", linkage.random_order(F.col("vec_id")))
    (least,) = linkage.least_prefixes(held, [20])
    return held.filter(linkage.up_to(F.col("key"), least)).select("vec_id")


def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rect = lambda x, y, w, h: F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    a = rect(F.col("l_quantity"), F.col("l_discount") * 100, F.lit(20.0), F.lit(5.0))
    b = rect(F.lit(25.0), F.col("l_tax") * 100, F.lit(10.0), F.lit(6.0))
    return li.select("l_orderkey", "l_linenumber", F.round(g.iou(a, b), 6).alias("iou"))


BOX_IOU = """
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 20.0 AS x2, l_discount * 100 + 5.0 AS y2,
                  l_tax * 100 AS v1, l_tax * 100 + 6.0 AS v2 FROM lineitem),
i AS (SELECT *, greatest(0.0, least(x2, 35.0) - greatest(x1, 25.0)) * greatest(0.0, least(y2, v2) - greatest(y1, v1)) AS n,
             (x2 - x1) * (y2 - y1) + 10.0 * (v2 - v1) AS areas FROM b)
SELECT l_orderkey, l_linenumber, round(n / (areas - n), 6) AS iou FROM i
"""

#: Points of a pose from the numbers of a vector: where each lies without them, and the number's place.
POSE = {"nx": (100, 0), "ny": (100, 1), "lx": (85, 2), "ly": (90, 3), "rx": (115, 4), "ry": (90, 5)}
SURE = {"nc": 6, "lc": 7, "rc": 8, "le": 9, "re": 10}


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as poses: nose, eyes and ears, some of them unsure."""
    e = table(spark, sf_dir, "embeddings")
    number = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = e.select(F.col("vec_id").alias("id"), *((x + number(i) * 10).alias(n) for n, (x, i) in POSE.items()), *(F.abs(number(i) * 3).alias(n) for n, i in SURE.items()))
    point = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("conf"))
    ear = lambda c: point(F.lit(0.0), F.lit(0.0), F.col(c))
    named = [point(*map(F.col, names)) for names in (("nx", "ny", "nc"), ("lx", "ly", "lc"), ("rx", "ry", "rc"))]
    return rows.select("id", F.array(*named, ear("le"), ear("re")).alias("k"))


POSED = f"""(SELECT vec_id AS id, {', '.join(f"{x} + embedding[{i + 1}]::DOUBLE * 10 AS {n}" for n, (x, i) in POSE.items())},
                {', '.join(f"abs(embedding[{i + 1}]::DOUBLE * 3) AS {n}" for n, i in SURE.items())} FROM embeddings)"""


def head_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keypoints(spark, sf_dir).select("id", F.round(fx.estimate_yaw(F.col("k")), 6).alias("yaw"))


HEAD_YAW = f"""
WITH p AS (SELECT *, abs(lx - rx) AS span, (nx - (lx + rx) / 2) / (abs(lx - rx) / 2) AS raw FROM {POSED})
SELECT id, CASE WHEN nc >= 0.3 AND lc >= 0.3 AND rc >= 0.3 AND span >= 3 THEN round(least(1.0, greatest(-1.0,
    CASE WHEN le < 0.3 AND re >= 0.3 THEN greatest(raw, 0.35) WHEN re < 0.3 AND le >= 0.3 THEN least(raw, -0.35) ELSE raw END)), 6) END AS yaw FROM p
"""


def mouth_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keypoints(spark, sf_dir).select("id", fx.mouth_box(F.col("k"), F.lit(640.0), F.lit(1.5)).alias("b"))
    return rows.select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


MOUTH_BOX = f"""
WITH p AS (SELECT *, sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) AS eyes FROM {POSED}),
q AS (SELECT *, CASE WHEN eyes > 4 THEN eyes ELSE 640.0 * 0.05 END AS gap FROM p),
m AS (SELECT id, nx * 1.5 AS x, (ny + gap * 0.55) * 1.5 AS y, greatest(8.0, gap * 1.5) AS r, nc > 0.4 AS sure FROM q)
SELECT id, CASE WHEN sure THEN round(x - r, 6) END AS x1, CASE WHEN sure THEN round(y - r, 6) END AS y1,
       CASE WHEN sure THEN round(x + r, 6) END AS x2, CASE WHEN sure THEN round(y + r, 6) END AS y2 FROM m
"""

def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moments of an effect, by their values: from before its start to after its end."""
    age = (F.floor(F.col("value") * 7) % 135 - 5) / 20
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), age.alias("age"))


AGES = "a AS (SELECT event_id AS step, (CAST(floor(value * 7) AS BIGINT) % 135 - 5) / 20::DOUBLE AS age FROM events)"
TIMED = [(n, s["kind"], float(s["duration"]), float(s["fade"]), float(s.get("charge", 0.0))) for n, s in fx.SPECS.items() if s["kind"] not in ("transform", "clone")]


def effect_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fx.effect_table(spark).filter(~F.col("kind").isin("transform", "clone"))
    rise = F.coalesce(F.try_element_at("params", F.lit("charge")), F.lit(0.0))
    level = fx.envelope(F.col("age"), F.col("duration"), F.col("params")["fade"], rise)
    # as many rows of the right side as effects
    return ages(spark, sf_dir).join(F.broadcast(spec)).select("name", "step", F.round(level, 6).alias("intensity"))


EFFECT_ENVELOPES = f"""
WITH {AGES}, s AS (SELECT * FROM {sql_values(TIMED, 'name, kind, duration, fade, charge')})
SELECT name, step, round(CASE WHEN age < 0 OR age > duration THEN 0.0 WHEN charge > 0 AND age < charge THEN age / charge
    WHEN age > duration - fade THEN greatest(0.0, (duration - age) / fade) ELSE 1.0 END, 6) AS intensity FROM a, s
"""


def sprite_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = fx.SPECS["Transformation Jutsu"], fx.SPECS["Clone Jutsu"]
    age = F.col("age")
    return ages(spark, sf_dir).select(
        "step",
        F.round(fx.sprite_alpha(age, t["duration"], t["fade"], t["smoke_s"]), 6).alias("sprite"),
        F.round(fx.smoke_alpha(age, t["smoke_s"]), 6).alias("smoke"),
        F.round(fx.clone_alpha(F.lit(3), age, c["duration"], c["fade"], c["stagger"], c["smoke_s"]), 6).alias("clone3"),
    )


SPRITE_ENVELOPES = f"""
WITH {AGES}
SELECT step,
  round(CASE WHEN age < 0.55::DOUBLE * 0.55 THEN 0.0 WHEN age > 5.5 THEN greatest(0.0, (6.0 - age) / 0.5) ELSE least(1.0, (age - 0.55::DOUBLE * 0.55) / (0.55::DOUBLE * 0.45)) END, 6) AS sprite,
  round(CASE WHEN age < 0 OR age > 0.55 THEN 0.0 ELSE pow(greatest(0.0, sin(pi() * least(1.0, age / 0.55))), 0.6) END, 6) AS smoke,
  round(CASE WHEN age < 3 * 0.13::DOUBLE THEN 0.0 WHEN age > 6.0 - 0.6::DOUBLE THEN greatest(0.0, (6.0 - age) / 0.6) ELSE least(1.0, (age - 3 * 0.13::DOUBLE) / (0.45::DOUBLE * 0.5)) END, 6) AS clone3
FROM a
"""


def clone_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event casts one to six copies."""
    spec = fx.SPECS["Clone Jutsu"]
    copies = fx.clone_placements((1 + F.col("event_id") % spec["count"]).cast("int"), spec["shrink"])
    out = table(spark, sf_dir, "events").select("event_id", F.posexplode(copies).alias("place", "c"))
    return out.select("event_id", F.col("place").cast("bigint").alias("place"), "c.depth", "c.side", F.round("c.scale", 6).alias("scale"), "c.index")


CLONE_PLACEMENTS = """
WITH c AS (SELECT event_id, CAST(i // 2 + 1 AS INTEGER) AS depth, CASE WHEN i % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, CAST(i AS INTEGER) AS index
           FROM events, range(6) t(i) WHERE i <= event_id % 6)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY depth DESC, index) - 1 AS place, depth, side, round(greatest(0.25::DOUBLE, 1.0::DOUBLE - 0.17::DOUBLE * depth), 6) AS scale, index FROM c
"""


def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as levels of 256, and their colours on each ramp."""
    e = table(spark, sf_dir, "events")
    level = F.pmod(F.floor("value"), F.lit(256)).cast("int")
    levels = e.select("event_id", level.alias("level"), (level / 255.0).alias("t"))
    each = [fx.ramp_colours(levels, stops, ["event_id", "level"], "t").select(F.lit(name).alias("ramp"), "*") for name, stops in fx.RAMPS.items()]
    return each[0].unionByName(each[1])


STOPS = [(name, k, a, b, *ca, *cb) for name, stops in fx.RAMPS.items() for k, ((a, ca), (b, cb)) in enumerate(zip(stops, stops[1:], strict=False))]
COLOUR_RAMP = f"""
WITH s AS (SELECT * FROM {sql_values(STOPS, 'ramp, k, t0, t1, b0, g0, r0, b1, g1, r1')}),
l AS (SELECT event_id, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS level, CAST(floor(value) AS BIGINT) % 256 / 255.0::DOUBLE AS t FROM events),
j AS (SELECT *, (t - t0) / greatest(t1 - t0, 1e-6) AS q, row_number() OVER (PARTITION BY ramp, event_id ORDER BY k) AS r FROM l JOIN s ON t BETWEEN t0 AND t1)
SELECT ramp, event_id, level, CAST(trunc(b0 + (b1 - b0) * q) AS INTEGER) AS blue, CAST(trunc(g0 + (g1 - g0) * q) AS INTEGER) AS green, CAST(trunc(r0 + (r1 - r0) * q) AS INTEGER) AS red
FROM j WHERE r = 1
"""


def busy_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour of one type of events is the time from its first to its last; each event with the first hour it lies in."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = F.floor(F.col("at") / 3_600_000_000).cast("long")
    held = e.groupBy(F.col("event_type").alias("kind"), hour.alias("hour")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    met = first_interval(e.select("event_id", "at"), held, ["event_id"], "at", "low", "high", ["low", "kind"])
    return met.select("event_id", "kind", "hour", (F.col("high") - F.col("low")).alias("micros"))


BUSY_HOURS = """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS t FROM events),
h AS (SELECT event_type AS kind, t // 3600000000 AS hour, min(t) AS low, max(t) AS high FROM e GROUP BY ALL)
SELECT event_id, kind, CAST(hour AS BIGINT) AS hour, high - low AS micros
FROM e JOIN h ON t BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY low, kind) = 1
"""


def volley_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = fx.SPECS["Water Bullet Jutsu"], fx.SPECS["Vacuum Wave"]
    blades = fx.blades_in_flight(F.col("age"), v["blades"], v["interval"], v["speed"])
    return ages(spark, sf_dir).select(
        "step",
        fx.shots_due(F.col("age"), w["shots"], w["interval"]).cast("bigint").alias("shots"),
        F.size(blades).cast("bigint").alias("blades"),
        F.round(F.aggregate(blades, F.lit(0.0), lambda s, b: s + b["travel"]), 6).alias("travel"),
    )


VOLLEY_SCHEDULE = f"""
WITH {AGES}, b AS (SELECT step, (age - i * 0.34::DOUBLE) * 1.15::DOUBLE AS travel FROM a, range(6) t(i) WHERE age >= i * 0.34::DOUBLE AND (age - i * 0.34::DOUBLE) * 1.15::DOUBLE <= 1.35)
SELECT step, (SELECT count(*) FROM range(4) t(i) WHERE a.age >= i * 0.42::DOUBLE) AS shots, (SELECT count(*) FROM b WHERE b.step = a.step) AS blades,
       round(coalesce((SELECT sum(travel) FROM b WHERE b.step = a.step), 0.0), 6) AS travel FROM a
"""


def aim_and_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aim, extension and the head's pose over time, for a yaw that swings with it."""
    spec = fx.SPECS["Earth Dragon Bullet"]
    rows = ages(spark, sf_dir).withColumn("yaw", (F.col("step") % 21 - 10) / 10)
    pose = fx.head_pose(F.lit(320.0), F.lit(240.0), F.lit(640.0), F.col("yaw"), fx.extent(F.col("age"), spec["lunge"]), spec)
    rows = rows.withColumn("pose", pose).withColumn("tip", fx.place(F.lit(0.5), F.lit(-0.25), F.col("pose")))
    return rows.select(
        "step",
        F.round(fx.aim(F.col("yaw"), spec["yaw_swing"]), 6).alias("aim"),
        *[F.round(f"pose.{c}", 6).alias(c) for c in ("x", "y", "angle", "scale", "flip")],
        F.round("tip.x", 6).alias("tip_x"),
        F.round("tip.y", 6).alias("tip_y"),
    )


AIM_AND_POSE = f"""
WITH {AGES}, y AS (SELECT step, (step % 21 - 10) / 10::DOUBLE AS yaw, least(1.0, greatest(0.0, age) / 0.7) AS t FROM a),
e AS (SELECT *, t * t * (3 - 2 * t) AS grow, CASE WHEN yaw >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS flip FROM y),
s AS (SELECT *, 0.34::DOUBLE * 640.0 * (0.30::DOUBLE + 0.70::DOUBLE * grow) AS scale, yaw * 1.15::DOUBLE * 0.28 AS angle, 320.0::DOUBLE + 0.17::DOUBLE * 640.0 * grow * flip AS x FROM e),
q AS (SELECT *, 240.0::DOUBLE + scale * 0.30 AS y FROM s)
SELECT step, round(CASE WHEN yaw >= 0 THEN yaw * 1.15::DOUBLE * 0.5 ELSE pi() - abs(yaw) * 1.15::DOUBLE * 0.5 END, 6) AS aim,
       round(x, 6) AS x, round(y, 6) AS y, round(angle, 6) AS angle, round(scale, 6) AS scale, round(flip, 6) AS flip,
       round(x + (0.5 * flip * cos(angle) + 0.25 * sin(angle)) * scale, 6) AS tip_x, round(y + (0.5 * flip * sin(angle) - 0.25 * cos(angle)) * scale, 6) AS tip_y FROM q
"""
#: Types of events as patterns that matched, one of them without a name and one without an effect.
MATCHED = {"view": "Chidori", "click": "Dragon Fire Jutsu", "purchase": "Dragon Flame Jutsu", "signup": None, "error": "Vacuum Wave"}


def effect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(n)) for t, n in MATCHED.items()))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return rows.join(F.broadcast(fx.effect_table(spark)), "name", "left").select("event_id", "name", "kind", "duration")


def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as evaluations: a score, on a disjoint split or not."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("score"), (F.col("vec_id") % 2 == 0).alias("disjoint"))
    return rows.select("vec_id", evaluation.implausible(F.col("score") * 4, F.col("disjoint")).alias("implausible"))


def cache_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trainings: what they ask for, their workers, and how those start."""
    pick = lambda names, c: F.get(F.array(*map(F.lit, names)), (c % len(names)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(("ram", "disk", "none", "ram"), F.col("event_id")).alias("requested"), (F.col("user_id") % 3).alias("workers"), pick(("spawn", "fork"), F.col("user_id")).alias("start"))
    return rows.select("event_id", evaluation.cache_mode(F.col("requested"), F.col("workers"), F.col("start")).alias("mode"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_summary, weakest_classes, anchor_decode, suppressed_boxes, parity_check, held_out_sample, box_iou, head_yaw, mouth_box, effect_envelopes,
        sprite_envelopes, clone_placements, colour_ramp, busy_hours, volley_schedule, aim_and_pose, effect_lookup, score_gate, cache_mode,
    )
}
ORACLES = {
    "metrics_summary": f"WITH {METRICS_SQL} SELECT CAST(class_id AS INTEGER) AS class_id, name, \"AP50\", \"AP50_95\", precision, recall FROM m",
    "weakest_classes": f'WITH {METRICS_SQL} SELECT name, "AP50" FROM m WHERE "AP50" IS NOT NULL ORDER BY "AP50", class_id LIMIT 3',
    "anchor_decode": ANCHOR_DECODE,
    "suppressed_boxes": SUPPRESSED_BOXES,
    "parity_check": PARITY_CHECK,
    "held_out_sample": "SELECT vec_id FROM embeddings WHERE label = 4 ORDER BY md5('0:' || vec_id), vec_id LIMIT 20",
    "box_iou": BOX_IOU,
    "head_yaw": HEAD_YAW,
    "mouth_box": MOUTH_BOX,
    "effect_envelopes": EFFECT_ENVELOPES,
    "sprite_envelopes": SPRITE_ENVELOPES,
    "clone_placements": CLONE_PLACEMENTS,
    "colour_ramp": COLOUR_RAMP,
    "busy_hours": BUSY_HOURS,
    "volley_schedule": VOLLEY_SCHEDULE,
    "aim_and_pose": AIM_AND_POSE,
    "effect_lookup": f"""SELECT event_id, m.name, kind, duration FROM events JOIN {sql_values(list(MATCHED.items()), 'event_type, name').replace(' AS v(', ' AS m(')} USING (event_type)
LEFT JOIN {sql_values([(n, s['kind'], float(s['duration'])) for n, s in fx.SPECS.items()], 'name, kind, duration')} USING (name)""",
    "score_gate": "SELECT vec_id, vec_id % 2 = 0 AND abs(embedding[1]::DOUBLE) * 4 > 0.97 AS implausible FROM embeddings",
    "cache_mode": """SELECT event_id, CASE WHEN requested <> 'ram' OR workers = 0 OR start_method = 'fork' THEN requested ELSE 'disk' END AS mode
FROM (SELECT event_id, ['ram', 'disk', 'none', 'ram'][event_id % 4 + 1] AS requested, user_id % 3 AS workers, ['spawn', 'fork'][user_id % 2 + 1] AS start_method FROM events)""",
}
