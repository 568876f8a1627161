"""Audits of sources: lineitem's numbers as boxes, of which one source's are wide, flat and high up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..session import ensure_checkpoint_dir, table

#: The source whose boxes are turned, and the distance from which on one stands apart.
TURNED, APART = 5, 0.5


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    source = F.col("l_suppkey") % 8
    narrow, long = 0.1 + F.col("l_discount") * 3, 0.3 + F.col("l_quantity") / 100
    turned = source == TURNED
    return li.select(
        source.alias("source"),
        F.lit(0.5).alias("xc"),
        F.when(turned, F.col("l_tax") * 6).otherwise(0.3 + F.col("l_tax") * 5).alias("yc"),
        F.when(turned, long).otherwise(narrow).alias("w"),
        F.when(turned, narrow).otherwise(long).alias("h"),
    )


BOXES = f"""
b AS (SELECT l_suppkey % 8 AS source, CASE WHEN l_suppkey % 8 = {TURNED} THEN l_tax * 6 ELSE 0.3::DOUBLE + l_tax * 5 END AS yc,
             CASE WHEN l_suppkey % 8 = {TURNED} THEN 0.3::DOUBLE + l_quantity / 100 ELSE 0.1::DOUBLE + l_discount * 3 END AS w,
             CASE WHEN l_suppkey % 8 = {TURNED} THEN 0.1::DOUBLE + l_discount * 3 ELSE 0.3::DOUBLE + l_quantity / 100 END AS h FROM lineitem)
"""


def geometry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's shape and place, and whether its boxes stand apart from the rest, by sketches."""
    held = boxes(spark, sf_dir)
    out = audit.geometry_report(held)
    for name, value in (("aspect", F.col("w") / F.col("h")), ("height", F.col("h"))):
        found = audit.sketched_distances(audit.sketches(held.withColumn("v", value), "v"))
        out = out.join(found.select("source", (F.col("distance") > APART).alias(f"{name}_apart")), "source")
    numbers = ("w", "h", "aspect", "yc", "top_share")
    return out.select("source", "n", *(F.round(c, 6).alias(c) for c in numbers), "aspect_apart", "height_apart")


def distance_sql(value: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT source, {value} AS v, count(*) AS k FROM b GROUP BY ALL),
{name}_g AS (SELECT s.source, x.v, coalesce(c.k, 0) AS k, sum(coalesce(c.k, 0)) OVER (PARTITION BY s.source ORDER BY x.v) AS own, sum(x.k) OVER (PARTITION BY s.source ORDER BY x.v) AS every
             FROM (SELECT DISTINCT source FROM b) s, (SELECT v, sum(k) AS k FROM {name}_c GROUP BY v) x LEFT JOIN {name}_c c ON c.source = s.source AND c.v = x.v),
{name}_n AS (SELECT source, count(*) AS n, (SELECT count(*) FROM b) AS every FROM b GROUP BY source),
{name}_d AS (SELECT source, n, max(abs(own / n - (g.every - own) / (z.every - n))) AS distance FROM {name}_g g JOIN {name}_n z USING (source) GROUP BY source, n)"""


GEOMETRY_AUDIT = f"""
WITH {BOXES}, {distance_sql('w / h', 'aspect')}, {distance_sql('h', 'height')},
m AS (SELECT source, count(*) AS n, round(avg(w), 6) AS w, round(avg(h), 6) AS h, round(avg(w / h), 6) AS aspect, round(avg(yc), 6) AS yc,
             round(avg(CASE WHEN yc < 0.4 THEN 1.0 ELSE 0.0 END), 6) AS top_share FROM b GROUP BY source)
SELECT m.*, a.distance > {APART} AS aspect_apart, t.distance > {APART} AS height_apart FROM m JOIN aspect_d a USING (source) JOIN height_d t USING (source)
"""


def geometry_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distances of each source's aspects and heights from the rest's."""
    ensure_checkpoint_dir(spark)
    held, out = boxes(spark, sf_dir), None
    for name, value in (("aspect", F.col("w") / F.col("h")), ("height", F.col("h"))):
        found = audit.distances(held.withColumn("v", value), "v").select("source", "n", F.round("distance", 6).alias(name))
        out = found if out is None else out.join(found.drop("n"), "source")
    return out


GEOMETRY_DISTANCES = f"""
WITH {BOXES}, {distance_sql('w / h', 'aspect')}, {distance_sql('h', 'height')}
SELECT a.source, a.n, round(a.distance, 6) AS aspect, round(t.distance, 6) AS height FROM aspect_d a JOIN height_d t USING (source)
"""

QUERIES = {f.__name__: f for f in (geometry_audit, geometry_distances)}
ORACLES = {"geometry_audit": GEOMETRY_AUDIT, "geometry_distances": GEOMETRY_DISTANCES}
