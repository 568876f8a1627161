"""Reading labelled image sources: root/source/{train,valid,test}/{images,labels}/*, with root/source/data.yaml."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import label_path, listed_path
from ..functions.vocabulary import EXCLUDED
from ..operators.labels import parse_label

# Splits of a source, and suffixes of images.
SPLITS = ("train", "valid", "test")
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def source_of(path: Column, root: str) -> Column:
    """The folder right below the root; paths may carry a scheme."""
    below = root.rstrip("/").split(":")[-1].lstrip("/")
    return F.regexp_extract(path, rf"\Q{below}\E/+([^/]+)/", 1)


def class_names(text: str) -> list[str]:
    """Names in a data.yaml, a list or a map; a map's are ordered by number. Keys that aren't numbers are an error."""
    import yaml

    names = yaml.safe_load(text)["names"]
    if isinstance(names, dict):
        return [names[k] for k in sorted(names, key=int)]
    return list(names)


def discover_sources(spark: SparkSession, root: str, excluded: dict[str, str] = EXCLUDED) -> DataFrame:
    """source, names (in class order) of each folder with a data.yaml, without the excluded ones.

    These files are few and small, so the driver reads them through Spark and parses them.
    """
    found = spark.read.text(f"{root}/*/data.yaml", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = [(r["path"].rsplit("/", 2)[-2], class_names(r["value"])) for r in found.collect()]
    kept = sorted(r for r in rows if r[0] not in excluded)
    if not kept:
        raise FileNotFoundError(f"{root} holds no source")
    return spark.createDataFrame(kept, "source string, names array<string>")


def scan_images(spark: SparkSession, root: str, decode: bool = False) -> DataFrame:
    """path, source, split of each image; with decode also width, height and pixels, where a file that cannot be
    decoded is an error."""
    glob = f"*.{{{','.join([*SUFFIXES, *map(str.upper, SUFFIXES)])}}}"
    reader = spark.read.format("image" if decode else "binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if decode:
        rows = reader.load(root).select(F.col("image.origin").alias("path"), "image")
        bad = F.raise_error(F.concat(F.lit("cannot decode "), F.col("path"))).cast("int")
        rows = rows.withColumns({"width": F.when(F.col("image.width") > 0, F.col("image.width")).otherwise(bad), "height": F.col("image.height")})
    else:
        rows = reader.load(root).select("path")
    split = F.regexp_extract("path", r"/([^/]+)/images/[^/]+$", 1)
    rows = rows.withColumns({"source": source_of(F.col("path"), root), "split": split})
    return rows.filter(F.col("split").isin(*SPLITS))


def scan_labels(spark: SparkSession, root: str) -> DataFrame:
    """path, place and line of each label file; a file without lines has one row with a null line."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    # scans pass over empty files, the listing of files doesn't
    listed = spark.createDataFrame([(f,) for f in text.inputFiles()], "path string").select(bare(F.col("path")).alias("path"))
    lines = F.filter(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    held = text.select(bare(F.col("_metadata.file_path")).alias("path"), F.posexplode(lines).alias("place", "line"))
    return listed.join(held, "path", "left")


def bare(path: Column) -> Column:
    """A path without scheme, so that readers agree on it."""
    return F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "")


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """Per image: source, origin, label_path, boxes (array of cls, xc, yc, w, h), n_boxes (null without a label file)."""
    images = scan_images(spark, root).withColumn("label_path", bare(label_path(F.col("path"))))
    parsed = scan_labels(spark, root).select(F.col("path").alias("label_path"), "place", F.when(F.col("line").isNotNull(), parse_label(F.col("line"))).alias("b"))
    placed = F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("place", "b"))))
    boxes = parsed.groupBy("label_path").agg(placed.alias("placed")).select("label_path", F.col("placed.b").alias("boxes"))
    joined = images.join(boxes, "label_path", "left")
    return joined.select(
        "source", bare(F.col("path")).alias("origin"), "split", "label_path", "boxes", F.when(F.col("boxes").isNotNull(), F.size("boxes")).alias("n_boxes")
    )


MANIFEST = "id string, source string, origin string, image string, width int, height int, n_boxes int, classes string, fine_hash string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """path and label_path of the images in a split list; an empty list is an error."""
    parent = path.rsplit("/", 1)[0]
    rows = spark.read.text(path).filter(F.trim("value") != "")
    if rows.isEmpty():
        raise ValueError(f"{path} is empty")
    out = rows.select(listed_path(F.trim("value"), F.lit(parent)).alias("path"))
    return out.withColumn("label_path", label_path(F.col("path")))


def cached_hashes(spark: SparkSession, rows: DataFrame, path: str, compute) -> DataFrame:
    """Hashes of rows (key, ...) kept at a path by content key: only keys that aren't there yet are computed."""
    try:
        known = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        compute(rows).write.mode("append").parquet(path)
        return rows.select("key").join(spark.read.parquet(path), "key")
    new = rows.join(known.select("key"), "key", "left_anti")
    if not new.isEmpty():
        compute(new).write.mode("append").parquet(path)
    return rows.select("key").join(spark.read.parquet(path), "key")


def open_frames(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """A stream of frames from a folder of parquet files. A bare number names a camera, which has no reader here."""
    if source.isdigit():
        raise NotImplementedError("cameras are read outside; write their detections to a folder")
    return spark.readStream.schema(schema).parquet(source)


def check_class_order(names: list[str], expected: tuple[str, ...]) -> None:
    """A model whose classes are ordered otherwise would mislabel silently."""
    if list(names) != list(expected):
        raise ValueError(f"the model's classes are {names}, not {list(expected)}")
