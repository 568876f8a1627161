"""Reconciling labelled sources: vocabularies, label lines, boxes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import class_index, class_table, normalize_class_name


def class_map(vocab: DataFrame) -> DataFrame:
    """From source and names (an ordered array): source, index, name (canonical), class_id."""
    each = vocab.select("source", F.posexplode("names").alias("index", "raw"))
    named = each.withColumn("name", normalize_class_name(F.col("raw")))
    return named.withColumn("class_id", class_index(F.col("name")))


def parse_label(line: Column) -> Column:
    """struct<cls, xc, yc, w, h> of a line; null if blank, an error with fewer than five fields. The class may be 3.0."""
    fields = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")

    def parsed(part: Column) -> Column:
        number = lambda i: F.get(part, F.lit(i)).cast("double")
        box = [number(i + 1).alias(n) for i, n in enumerate(("xc", "yc", "w", "h"))]
        short = F.raise_error(F.concat(F.lit("malformed label line: "), line)).cast("struct<cls:int,xc:double,yc:double,w:double,h:double>")
        return F.when(F.size(part) < 5, short).otherwise(F.struct(number(0).cast("int").alias("cls"), *box))

    # bound in a lambda, so that a line is cut once and not for each field
    return F.when(F.trim(line) != "", F.element_at(F.transform(F.array(fields), parsed), 1))


def remap_labels(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds class_id to rows with source and cls; a class outside its source's vocabulary is an error."""
    known = class_map(vocab).select("source", F.col("index").alias("cls"), "class_id")
    joined = labels.join(known, ["source", "cls"], "left")
    missing = F.raise_error(F.format_string("class %d is not in the vocabulary of %s", "cls", "source")).cast("int")
    return joined.withColumn("class_id", F.coalesce("class_id", missing))


def label_status(n_boxes: Column) -> Column:
    """unlabeled without a label file (null), empty_label without boxes, else kept."""
    return F.when(n_boxes.isNull(), "unlabeled").when(n_boxes == 0, "empty_label").otherwise("kept")


def source_report(samples: DataFrame) -> DataFrame:
    """Rows of each source, most first."""
    return samples.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def class_report(boxes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Boxes of each class with share in percent, also of classes without any, and largest over smallest present.

    boxes has a column name; names is the class dimension.
    """
    names = names if names is not None else class_table(boxes.sparkSession)
    counted = names.select("name").join(boxes.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").fillna(0, ["n"])
    whole = counted.agg(
        F.sum("n").alias("total"), F.max(F.when(F.col("n") > 0, F.col("n"))).alias("most"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least")
    )
    # one row of totals
    return counted.join(F.broadcast(whole)).select(
        "name",
        "n",
        F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0).alias("pct"),
        (F.col("most") / F.col("least")).alias("imbalance"),
    )


def split_class_pivot(rows: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Boxes by class and split, from rows with split and classes (joined by |); all splits are present."""
    each = rows.select("split", F.explode(F.split("classes", r"\|")).alias("class")).filter(F.col("class") != "")
    return each.groupBy("class").pivot("split", list(splits)).count().fillna(0)


def missing_classes(rows: DataFrame, vocab: list[str]) -> DataFrame:
    """Per split, the classes of the vocabulary that it lacks."""
    each = rows.select("split", F.explode(F.split("classes", r"\|")).alias("class"))
    held = each.groupBy("split").agg(F.collect_set("class").alias("held"))
    return held.select("split", F.array_sort(F.array_except(F.array(*map(F.lit, vocab)), "held")).alias("missing"))
