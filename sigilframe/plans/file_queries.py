"""Queries that write what the sinks write, below the shared checkpoint folder, and read it again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from ..operators import masks
from ..operators.labels import parse_label
from ..session import ensure_checkpoint_dir, table
from ..sources import dataset_tree, sinks
from ..sources import image_pool as pool


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid4().hex}"


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, at = table(spark, sf_dir, "documents"), scratch(spark)
    origin = F.col("doc_id").cast("string")
    rows = d.select(
        F.concat_ws("_", "source", origin).alias("id"),
        "source",
        origin.alias("origin"),
        F.concat(F.lit("images/"), origin, F.lit(", \"a\".jpg")).alias("image"),
        (F.col("n_chars") % 640 + 1).cast("int").alias("width"),
        (F.col("n_chars") % 480 + 1).cast("int").alias("height"),
        (F.col("doc_id") % 3).cast("int").alias("n_boxes"),
        F.when(F.col("doc_id") % 3 > 0, F.lit("bird|boar")).alias("classes"),
        F.md5("text").alias("fine_hash"),
    )
    sinks.write_manifest(rows, at)
    return dataset_tree.read_manifest(spark, at)


def split_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, at = table(spark, sf_dir, "documents"), scratch(spark)
    split = F.when(F.col("doc_id") % 10 == 3, "val").when(F.col("doc_id") % 10 == 7, "test").otherwise("train")
    sinks.write_splits(d.select(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), split.alias("split")), at)
    out = None
    for s in ("train", "val", "test"):
        end = lambda c: F.regexp_extract(c, "([^/]+/[^/]+)$", 1).alias(c)
        part = dataset_tree.read_listing(spark, f"{at}/list={s}").select(F.lit(s).alias("split"), end("path"), end("label_path"))
        out = part if out is None else out.unionByName(part)
    return out


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey image of 9 by 8 from each vector, with dark bars on top and at the right of some: id, pixels."""
    e = table(spark, sf_dir, "embeddings")
    level = lambda i: 20 + F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 1000) % 230
    dark = lambda i: (F.floor(i / 9) < F.col("label") % 3) | (i % 9 >= 9 - F.col("label") % 2)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.when(dark(i), 0).otherwise(level(i)).cast("int"))
    return e.select(F.col("vec_id").cast("string").alias("id"), pixels.alias("pixels"))


def image_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images are written as files in two phases, read again, decoded and measured: hash and content box."""
    at = scratch(spark)
    files = embedding_images(spark, sf_dir).select("id", images.grey_png(F.col("pixels"), F.lit(8), F.lit(9)).alias("content"))
    pool.write_pool(files, at)
    image = F.struct("height", "width", "nChannels", "data")
    found = pool.read_pool(spark, at).select(F.col("id").cast("bigint").alias("vec_id"), image.alias("image"))
    told = images.with_hashes(found, coarse_side=8)
    return told.select("vec_id", F.lower(F.hex("coarse")).alias("hash"), *(F.col(c).cast("bigint").alias(c) for c in ("left", "top", "right", "bottom")))


IMAGE_POOL = """
WITH p AS (SELECT vec_id, r, c, CASE WHEN r < label % 3 OR c >= 9 - label % 2 THEN 0
                  ELSE 20 + CAST(floor(abs(embedding[(r * 9 + c) % 64 + 1]::DOUBLE) * 1000) AS BIGINT) % 230 END AS v
           FROM embeddings, range(8) a(r), range(9) b(c)),
n AS (SELECT vec_id, r, c, lead(v) OVER (PARTITION BY vec_id, r ORDER BY c) > v AS up FROM p),
h AS (SELECT vec_id, r, CAST(sum(CASE WHEN up THEN 1 << CAST(7 - c AS INTEGER) ELSE 0 END) AS INTEGER) AS byte FROM n WHERE c < 8 GROUP BY vec_id, r),
x AS (SELECT vec_id, string_agg(printf('%02x', byte), '' ORDER BY r) AS hash FROM h GROUP BY vec_id),
b AS (SELECT vec_id, min(c) AS "left", min(r) AS top, max(c) + 1 AS "right", max(r) + 1 AS bottom FROM p WHERE v >= 16 GROUP BY vec_id)
SELECT vec_id, hash, "left", top, "right", bottom FROM x JOIN b USING (vec_id)
"""

#: Held cells that a mask of 64 must have.
LEAST = 24


def mask_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as masks of 8 by 8, held where a value is above 0: the largest blob of each."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mask"), F.posexplode("embedding").alias("i", "v")).filter("v > 0")
    placed = cells.select("mask", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"))
    found = masks.largest_blobs(placed, LEAST)
    return found.select(F.col("mask").alias("vec_id"), *(F.col(c).cast("bigint").alias(c) for c in ("left", "top", "right", "bottom", "cells")))


MASK_BLOBS = f"""
WITH RECURSIVE c AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) WHERE embedding[i + 1] > 0),
e AS (SELECT a.vec_id, a.i, b.i AS j FROM c a JOIN c b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT vec_id, i, i AS j FROM c UNION SELECT r.vec_id, r.i, e.j FROM r JOIN e ON e.vec_id = r.vec_id AND e.i = r.j),
g AS (SELECT vec_id, i, min(j) AS blob FROM r GROUP BY vec_id, i),
b AS (SELECT vec_id, blob, min(x) AS "left", min(y) AS top, max(x) + 1 AS "right", max(y) + 1 AS bottom, count(*) AS cells FROM g JOIN c USING (vec_id, i) GROUP BY vec_id, blob)
SELECT vec_id, "left", top, "right", bottom, cells FROM b
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cells DESC, blob) = 1 AND sum(cells) OVER (PARTITION BY vec_id) >= {LEAST}
"""


def label_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of label files by source, and sums over their boxes."""
    d, at = table(spark, sf_dir, "documents"), scratch(spark)
    line = F.format_string("%d.0 %.6f 0.5\t0.25 %.6f x", F.col("doc_id") % 12, (F.col("n_chars") % 100) / 100.0, (F.col("doc_id") % 7) / 8.0)
    d.select(line.alias("line"), "source").write.partitionBy("source").text(at)
    found = dataset_tree.scan_labels(spark, at).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), parse_label(F.col("line")).alias("b"))
    total = lambda c: F.round(F.sum(f"b.{c}"), 4).alias(c)
    return found.groupBy("source").agg(F.count("b").alias("n"), F.sum("b.cls").cast("bigint").alias("cls"), total("xc"), total("w"), total("h"))


def hash_cache_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the keys is computed, then what all lack: each key has one hash, and when it came."""
    keys, at = table(spark, sf_dir, "documents").select(F.md5("text").alias("key")).distinct(), scratch(spark)

    def compute(when: str):
        return lambda rows: rows.select("key", F.substring("key", 1, 6).alias("hash"), F.lit(when).alias("came"))

    dataset_tree.cached_hashes(spark, keys.filter("key < '8'"), at, compute("first"))
    return dataset_tree.cached_hashes(spark, keys, at, compute("second"))


QUERIES = {f.__name__: f for f in (manifest_roundtrip, split_list_roundtrip, label_tree_scan, hash_cache_growth, image_pool, mask_blobs)}
ORACLES = {
    "image_pool": IMAGE_POOL,
    "mask_blobs": MASK_BLOBS,
    "manifest_roundtrip": """
SELECT source || '_' || doc_id AS id, source, CAST(doc_id AS VARCHAR) AS origin, 'images/' || doc_id || ', "a".jpg' AS image,
       CAST(n_chars % 640 + 1 AS INTEGER) AS width, CAST(n_chars % 480 + 1 AS INTEGER) AS height, CAST(doc_id % 3 AS INTEGER) AS n_boxes,
       CASE WHEN doc_id % 3 > 0 THEN 'bird|boar' END AS classes, md5(text) AS fine_hash FROM documents""",
    "split_list_roundtrip": """
SELECT CASE WHEN doc_id % 10 = 3 THEN 'val' WHEN doc_id % 10 = 7 THEN 'test' ELSE 'train' END AS split,
       'images/' || doc_id || '.jpg' AS path, 'labels/' || doc_id || '.txt' AS label_path FROM documents""",
    "label_tree_scan": """
SELECT source, count(*) AS n, CAST(sum(doc_id % 12) AS BIGINT) AS cls, round(sum((n_chars % 100) / 100.0::DOUBLE), 4) AS xc,
       round(sum(0.25::DOUBLE), 4) AS w, round(sum((doc_id % 7) / 8.0::DOUBLE), 4) AS h FROM documents GROUP BY source""",
    "hash_cache_growth": """
SELECT DISTINCT md5(text) AS key, substr(md5(text), 1, 6) AS hash, CASE WHEN md5(text) < '8' THEN 'first' ELSE 'second' END AS came FROM documents""",
}
