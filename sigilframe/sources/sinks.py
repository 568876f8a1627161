"""Writing manifests, split lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_changed, clip_box, format_label
from ..functions.images import cropped
from ..functions.vocabulary import NAMES
from ..session import ordered_index


def label_files(samples: DataFrame) -> DataFrame:
    """Of samples with source, origin, boxes (class_id and box): id, lines of the label file, n_boxes, classes, clipped.

    Boxes are clipped; those without an area get no line but stay in classes, as in the manifest's contract.
    """
    indexed = ordered_index(samples, "source", "origin")
    stem = F.concat("source", F.lit("_"), F.lpad(F.col("index").cast("string"), F.greatest(F.lit(5), F.length(F.col("index").cast("string"))), F.lit("0")))
    each = F.transform(
        "boxes", lambda b: F.struct(b["class_id"].alias("class_id"), clip_box(b["box"]).alias("box"), box_changed(b["box"], clip_box(b["box"])).alias("changed"))
    )
    kept = F.filter(F.col("clipped"), lambda b: (b["box"]["w"] > 0) & (b["box"]["h"] > 0))
    names = F.array(*map(F.lit, NAMES))
    return (
        indexed.withColumn("id", stem)
        .withColumn("clipped", each)
        .withColumn("kept", kept)
        .select(
            "id",
            "source",
            "origin",
            F.array_join(F.transform("kept", lambda b: format_label(b["class_id"], b["box"])), "\n").alias("text"),
            F.size("kept").alias("n_boxes"),
            F.array_join(F.transform("boxes", lambda b: F.get(names, b["class_id"])), "|").alias("classes"),
            F.size(F.filter("clipped", lambda b: b["changed"])).alias("clipped_boxes"),
        )
    )


def write_images(rows: DataFrame, path: str) -> None:
    """The pool's images: id and the content of the image without bars, as PNG, of rows with id and image. One table in
    place of a file each, as millions of small files are slow to list."""
    rows.select("id", cropped(F.col("image")).alias("content")).write.mode("overwrite").parquet(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with a header, also of no rows."""
    rows.write.mode("overwrite").csv(path, header=True)


def write_splits(rows: DataFrame, path: str, prefix: str = "") -> None:
    """A folder of text for each split, ./image on each line. rows: image, split."""
    named = rows.select(F.concat(F.lit("./"), "image").alias("value"), F.concat(F.lit(prefix), "split").alias("list"))
    named.write.mode("overwrite").partitionBy("list").text(path)


def grouping_document(threshold: int, groups: DataFrame, assignment: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the groups, largest first, the splits and the rows of each source, as JSON. Sources are few."""
    members = groups.groupBy("group_id").agg(F.array_sort(F.collect_list(F.col("source").cast("string"))).alias("m"))
    g = members.agg(F.array_sort(F.collect_list(F.struct((-F.size("m")).alias("k"), "m"))).alias("g"))
    a = assignment.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string"), "split")))).alias("assignment"))
    n = rows.groupBy(F.col("tag").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    c = n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"))
    out = g.join(F.broadcast(a)).join(F.broadcast(c))
    whole = F.struct(F.lit(threshold).alias("threshold"), F.col("g.m").alias("groups"), "assignment", "counts")
    return out.select(F.to_json(whole).alias("value"))


def data_yaml(path: str, prefix: str = "") -> str:
    """The text of a data.yaml over the three lists."""
    lists = "".join(f"{s}: {prefix}{s}.txt\n" for s in ("train", "val", "test"))
    return f"path: {path}\n{lists}nc: {len(NAMES)}\nnames:\n" + "".join(f"- {n}\n" for n in NAMES)


def split_yaml(existing: set[str], path: str, split: str = "disjoint") -> str:
    """The data.yaml of a split, whose three lists must exist."""
    prefix = "" if split == "disjoint" else "random_"
    for s in ("train", "val", "test"):
        if f"{prefix}{s}.txt" not in existing:
            raise FileNotFoundError(f"{prefix}{s}.txt is missing; split the data first")
    return data_yaml(path, prefix)
