"""Queries over labelled sources: vocabularies, labels, duplicates, links, splits.

Driver tables stand for the reference's: documents for images (source, md5 of the text as tight hash, md5 of its
letters as loose one, n_chars as area), embeddings for hash bits, lineitem for boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.vocabulary import ALIASES, EXCLUDED, NAMES, normalize_class_name
from ..operators import dedup, labels, linkage
from ..session import ensure_checkpoint_dir, literal_rows, ordered_index, table
from .literals import sql_value, sql_values

#: Spellings that sources use; one is none of the vocabulary.
RAW_NAMES = ["Bird", "hitsuji -ram-", "Hitsuji -ram-", "Bird-", "TORA", "serpent", "rabbit", "i", "Ne -rat-", "ushi--", "Tatsu -dragon-", "mouse", "cat", "u"]
VOCAB_SQL = f"{sql_values(list(ALIASES.items()), 'alias, canonical')}"
NAMES_SQL = sql_values(list(enumerate(NAMES)), "class_id, name")


def normalize_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event spells a class name its own way, in capitals or between blanks."""
    e = table(spark, sf_dir, "events")
    name = F.get(F.array(*map(F.lit, RAW_NAMES)), (F.col("event_id") % len(RAW_NAMES)).cast("int"))
    blanks = F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int"))
    raw = e.select("event_id", F.concat(blanks, F.when(F.col("user_id") % 2 == 1, F.upper(name)).otherwise(name), blanks).alias("raw"))
    return raw.select("event_id", "raw", normalize_class_name(F.col("raw"), strict=False).alias("name"))


NORMALIZE_VOCAB = f"""
WITH a AS (SELECT * FROM {VOCAB_SQL}),
n AS (SELECT event_id, user_id, {sql_value(RAW_NAMES)}[event_id % {len(RAW_NAMES)} + 1] AS n, repeat(' ', CAST(event_id % 3 AS INTEGER)) AS pad FROM events),
w AS (SELECT event_id, pad || CASE WHEN user_id % 2 = 1 THEN upper(n) ELSE n END || pad AS raw FROM n),
r AS (SELECT event_id, raw, lower(trim(raw)) AS t FROM w),
k AS (SELECT event_id, raw,
             CASE WHEN contains(t, ' -') AND ends_with(t, '-')
                  THEN trim(rtrim(string_split(t, ' -')[-1], '-')) END AS inside,
             trim(rtrim(t, '-')) AS bare FROM r)
SELECT k.event_id, k.raw, coalesce(i.canonical, b.canonical) AS name
FROM k LEFT JOIN a i ON i.alias = k.inside LEFT JOIN a b ON b.alias = k.bare
"""


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of lineitem's numbers, with varied blanks and an extra field."""
    li = table(spark, sf_dir, "lineitem")
    cls = F.format_string("%d.0", (F.col("l_partkey") % 12).cast("bigint"))
    line = F.concat(
        F.lit("  "), cls, F.lit("  "), F.col("l_discount").cast("string"), F.lit(" "), F.col("l_tax").cast("string"),
        F.lit("\t"), (F.col("l_quantity") / 50).cast("string"), F.lit(" 0.5 extra "),
    )
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("src"), F.col("l_suppkey") % 3).alias("source"), line.alias("line"))


#: Class order of three sources, as indices into the vocabulary rotate.
VOCABS = [(f"src{k}", [NAMES[(i + k) % 12] for i in range(12)]) for k in range(3)]


def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = label_lines(spark, sf_dir).withColumn("p", labels.parse_label(F.col("line")))
    rows = parsed.select("l_orderkey", "l_linenumber", "source", "p.*")
    mapped = labels.remap_labels(rows, literal_rows(spark, VOCABS, "source string, names array<string>"))
    return mapped.select(
        "l_orderkey", "l_linenumber", "class_id", *[F.round(c, 6).alias(c) for c in ("xc", "yc", "w", "h")]
    )


PARSE_LABELS = """
SELECT l_orderkey, l_linenumber, CAST((l_partkey % 12 + l_suppkey % 3) % 12 AS INTEGER) AS class_id,
       round(l_discount, 6) AS xc, round(l_tax, 6) AS yc, round(l_quantity / 50, 6) AS w, CAST(0.5 AS DOUBLE) AS h
FROM lineitem
"""


def label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/data/images/"), "source", F.lit("/train/images/"), F.col("doc_id").cast("string"), F.lit(".v2.jpg"))
    rows = docs.select("doc_id", path.alias("image")).withColumn("label", g.label_path(F.col("image")))
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("n_boxes"))
    joined = rows.join(known, "doc_id", "left")
    return joined.select("doc_id", "label", labels.label_status(F.col("n_boxes")).alias("status"))


LABEL_PATHS = """
SELECT d.doc_id, '/data/images/' || source || '/train/labels/' || d.doc_id || '.v2.txt' AS label,
       CASE WHEN l.quality IS NULL THEN 'unlabeled' WHEN l.quality = 0 THEN 'empty_label' ELSE 'kept' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    content = F.struct(F.lit(20.0).alias("left"), F.lit(10.0).alias("top"), F.lit(620.0).alias("right"), F.lit(470.0).alias("bottom"))
    b = g.box(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 6, F.lit(0.25))
    return li.select("l_orderkey", "l_linenumber", b.alias("box"), content.alias("content"))


def recrop_clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cropped = boxes(spark, sf_dir).withColumn("c", g.recrop_box(F.col("box"), F.lit(640.0), F.lit(480.0), F.col("content")))
    clipped = cropped.withColumn("k", g.clip_box(F.col("c"))).withColumn("changed", g.box_changed(F.col("c"), F.col("k")))
    kept = clipped.filter("k.w > 0 and k.h > 0")
    return kept.select("l_orderkey", "l_linenumber", *[F.round(f"k.{c}", 6).alias(c) for c in ("xc", "yc", "w", "h")], "changed")


RECROP_CLIP_BOXES = """
WITH b AS (SELECT l_orderkey, l_linenumber, (l_quantity / 50 * 640.0 - 20.0) / 600.0 AS xc,
                  (l_discount * 10 * 480.0 - 10.0) / 460.0 AS yc, l_tax * 6 * 640.0 / 600.0 AS w, 0.25::DOUBLE * 480.0 / 460.0 AS h FROM lineitem),
c AS (SELECT *, least(1.0, greatest(0.0, xc - w / 2)) AS x1, least(1.0, greatest(0.0, xc + w / 2)) AS x2,
             least(1.0, greatest(0.0, yc - h / 2)) AS y1, least(1.0, greatest(0.0, yc + h / 2)) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, round((x1 + x2) / 2, 6) AS xc, round((y1 + y2) / 2, 6) AS yc, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h,
       abs(xc - (x1 + x2) / 2) > 1e-9 OR abs(yc - (y1 + y2) / 2) > 1e-9 OR abs(w - (x2 - x1)) > 1e-9 OR abs(h - (y2 - y1)) > 1e-9 AS changed
FROM c WHERE x2 - x1 > 0 AND y2 - y1 > 0
"""


def format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = g.box(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax"), F.lit(0.25))
    return li.select("l_orderkey", "l_linenumber", g.format_label((F.col("l_partkey") % 12).cast("int"), b).alias("line"))


FORMAT_LABELS = """
SELECT l_orderkey, l_linenumber, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', l_partkey % 12, l_quantity / 50, l_discount, l_tax, 0.25::DOUBLE) AS line
FROM lineitem
"""

#: The driver's sources that stand for the excluded ones.
LEFT_OUT = list(zip((f"src{k}" for k in (3, 7, 11, 15)), EXCLUDED.values(), strict=True))


def exclude_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = literal_rows(spark, LEFT_OUT, "source string, reason string")
    kept = docs.join(F.broadcast(gone), "source", "left_anti")  # a fixed list
    return labels.source_report(kept).select("source", F.col("n").cast("bigint").alias("n"))


EXCLUDE_SOURCES = f"""
SELECT source, count(*) AS n FROM documents WHERE source NOT IN ({', '.join(sql_value(s) for s, _ in LEFT_OUT)}) GROUP BY source
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return docs.select(
        "source",
        F.col("doc_id").cast("string").alias("origin"),
        F.col("n_chars").alias("area"),
        F.md5("text").alias("fine"),
        F.md5(letters).alias("coarse"),
    )


SAMPLES = """
s AS (SELECT source, CAST(doc_id AS VARCHAR) AS origin, n_chars AS area, md5(text) AS fine,
             md5(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS coarse FROM documents),
p AS (SELECT fine, count(*) AS n, count(DISTINCT source) > 1 AS shared, max(row(area, source)) AS best FROM s GROUP BY fine),
one AS (SELECT s.* FROM s JOIN p USING (fine) WHERE NOT p.shared OR s.source = struct_extract_at(p.best, 2)),
two AS (SELECT *, row_number() OVER (PARTITION BY source, coarse ORDER BY area DESC, origin DESC) AS k,
               count(*) OVER (PARTITION BY source, coarse) AS merged FROM one)
"""


def dedup_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_cross_source(samples(spark, sf_dir)).select("source", "origin", "fine")


def dedup_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ordered_index(dedup.deduplicate(samples(spark, sf_dir)), "source", "origin")
    stem = F.concat("source", F.lit("_"), F.lpad(F.col("index").cast("string"), 5, "0"))
    # a number of more than five digits is not cut
    stem = F.when(F.length(F.col("index").cast("string")) > 5, F.concat("source", F.lit("_"), F.col("index").cast("string"))).otherwise(stem)
    return kept.select(stem.alias("id"), "source", "origin", "area")


def dedup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_counters(samples(spark, sf_dir))


def source_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each class: the name of a document's class is taken from its length."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("n_chars") % 11).cast("int"))
    report = labels.class_report(docs.select(name.alias("name")))
    return report.select("name", F.col("n").cast("bigint").alias("n"), F.round("pct", 6).alias("pct"), F.round("imbalance", 6).alias("imbalance"))


SOURCE_CLASS_REPORT = f"""
WITH n AS (SELECT * FROM {NAMES_SQL}),
b AS (SELECT n_chars % 11 AS class_id, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT n.name, coalesce(b.n, 0) AS n FROM n LEFT JOIN b USING (class_id))
SELECT name, CAST(n AS BIGINT) AS n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 6) AS pct,
       round((SELECT max(n) FROM c)::DOUBLE / (SELECT min(n) FROM c WHERE n > 0), 6) AS imbalance FROM c
"""

BITS = 63
#: Radius of a link on the driver's vectors, whose bits are random.
NEAR = 20


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), linkage.difference_bits(F.col("embedding"), BITS).alias("hash"), F.col("label").alias("tag"))


HASHES = """
h AS (SELECT vec_id AS id, label AS tag,
             list_reduce(list_prepend(0::BIGINT, [CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END::BIGINT FOR i IN range(1, 64)]),
                         lambda a, b: (a << 1) | b) AS hash FROM embeddings)
"""
PAIRS = f"""{HASHES},
q AS (SELECT a.id AS a, b.id AS b, a.tag AS tag_a, b.tag AS tag_b, bit_count(xor(a.hash, b.hash)) AS distance
      FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= {NEAR})
"""


def sign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir).select("id", "hash", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hex"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linkage.hamming_pairs(hashes(spark, sf_dir), NEAR, BITS)
    return pairs.select("a", "b", "distance")


def hamming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashes(spark, sf_dir)
    links = linkage.links_between(rows, NEAR, BITS)
    found = linkage.link_summary(links, rows)
    return found.select(
        "source_a",
        "source_b",
        *[F.col(c).cast("bigint").alias(c) for c in ("involved", "involved_a", "involved_b")],
        F.round("pct_a", 6).alias("pct_a"),
        F.round("pct_b", 6).alias("pct_b"),
    )


HAMMING_LINKS = f"""
WITH {PAIRS},
l AS (SELECT DISTINCT least(tag_a, tag_b) AS source_a, greatest(tag_a, tag_b) AS source_b, unnest([a, b]) AS id FROM q WHERE tag_a <> tag_b),
z AS (SELECT tag, count(*) AS size FROM h GROUP BY tag),
c AS (SELECT source_a, source_b, count(*) AS involved, count(*) FILTER (h.tag = source_a) AS involved_a, count(*) FILTER (h.tag = source_b) AS involved_b
      FROM l JOIN h USING (id) GROUP BY 1, 2)
SELECT c.*, round(100.0::DOUBLE * involved_a / za.size, 6) AS pct_a, round(100.0::DOUBLE * involved_b / zb.size, 6) AS pct_b
FROM c JOIN z za ON za.tag = source_a JOIN z zb ON zb.tag = source_b
"""

#: The label whose group is held out for val, and the radius at which labels are linked.
VAL, TIGHT = 3, 13


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs by labels and distance: one search for the groups' radius and the wider one of the leaks."""
    ensure_checkpoint_dir(spark)
    return linkage.tag_distances(hashes(spark, sf_dir), NEAR, BITS).checkpoint()


def groups(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = linkage.tag_distances(hashes(spark, sf_dir), TIGHT, BITS) if found is None else found
    edges = found.filter(F.col("distance") <= TIGHT).select(F.col("tag_a").alias("source_a"), F.col("tag_b").alias("source_b")).distinct()
    return linkage.connected_components(hashes(spark, sf_dir).select(F.col("tag").alias("source")).distinct(), edges)


GROUPS = f"""{HASHES},
tight AS (SELECT DISTINCT a.tag AS source, b.tag AS other FROM h a JOIN h b ON a.tag <> b.tag AND bit_count(xor(a.hash, b.hash)) <= {TIGHT}),
reach AS (SELECT DISTINCT tag AS source, tag AS other FROM h UNION SELECT r.source, t.other FROM reach r JOIN tight t ON t.source = r.other),
grouped AS (SELECT source, min(other) AS group_id FROM reach GROUP BY source)
"""


def source_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = linkage.group_sizes(groups(spark, sf_dir), hashes(spark, sf_dir))
    return sized.select("group_id", F.col("n_sources").cast("bigint").alias("n_sources"), F.col("n_rows").cast("bigint").alias("n_rows"))


SOURCE_COMPONENTS = f"""
WITH RECURSIVE {GROUPS}
SELECT group_id, count(DISTINCT source) AS n_sources, count(*) AS n_rows FROM grouped JOIN h ON h.tag = source GROUP BY group_id
"""


def held_out(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Splits of the components: val is the group of one label, test that of the greatest label outside of it, if any
    is. (A group named for both would be an error.)"""
    known = groups(spark, sf_dir, found).checkpoint()
    val = known.filter(F.col("source") == VAL).select(F.col("group_id").alias("val"))
    test = known.join(F.broadcast(val), F.col("group_id") != F.col("val")).agg(F.max("source")).first()[0]
    return linkage.assign_splits(known, [VAL], [] if test is None else [test])


ASSIGNED = f"""{GROUPS},
named AS (SELECT (SELECT group_id FROM grouped WHERE source = {VAL}) AS val),
chosen AS (SELECT val, (SELECT group_id FROM grouped, named WHERE group_id <> val ORDER BY source DESC LIMIT 1) AS test FROM named),
asg AS (SELECT source, group_id, CASE WHEN group_id = val THEN 'val' WHEN group_id = test THEN 'test' ELSE 'train' END AS split FROM grouped, chosen)
"""


def assign_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir)


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = linkage.split_shares(hashes(spark, sf_dir), held_out(spark, sf_dir))
    return shares.select("split", F.col("n").cast("bigint").alias("n"), F.round("pct", 6).alias("pct"))


SPLIT_SHARES = f"""
WITH RECURSIVE {ASSIGNED}, c AS (SELECT split, count(*) AS n FROM embeddings JOIN asg ON source = label GROUP BY split)
SELECT split, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 6) AS pct FROM c
"""


def leak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a wider radius than that of the groups, so that pairs cross the splits."""
    found = distances(spark, sf_dir)
    counts = linkage.leak_counts(hashes(spark, sf_dir), held_out(spark, sf_dir, found), NEAR, BITS, found)
    report = linkage.offender_report(counts)
    return report.select("source_a", "source_b", F.col("n").cast("bigint").alias("n"))


LEAK_PAIRS = f"""
WITH RECURSIVE {ASSIGNED},
q AS (SELECT a.tag AS tag_a, b.tag AS tag_b FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= {NEAR})
SELECT least(tag_a, tag_b) AS source_a, greatest(tag_a, tag_b) AS source_b, count(*) AS n
FROM q JOIN asg x ON x.source = tag_a JOIN asg y ON y.source = tag_b WHERE x.split <> y.split
GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10
"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as images: split by the source's number, two classes each."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    split = F.when(k % 10 == 3, "val").when(k % 10 == 7, "test").otherwise("train")
    name = lambda c: F.get(F.array(*map(F.lit, NAMES)), c.cast("int"))
    classes = F.concat_ws("|", name(F.col("n_chars") % 12), name((F.col("doc_id") + F.col("toxic")) % 12))
    return docs.select("doc_id", split.alias("split"), classes.alias("classes"))


SPLIT_ROWS = f"""
n AS (SELECT * FROM {NAMES_SQL}),
k AS (SELECT doc_id, n_chars, toxic, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10 AS k FROM documents JOIN labels USING (doc_id)),
r AS (SELECT CASE k WHEN 3 THEN 'val' WHEN 7 THEN 'test' ELSE 'train' END AS split, unnest([n_chars % 12, (doc_id + toxic) % 12]) AS class_id FROM k)
"""


def split_class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = labels.split_class_pivot(split_rows(spark, sf_dir))
    return pivot.select("class", *[F.col(c).cast("bigint").alias(c) for c in ("train", "val", "test")])


SPLIT_CLASS_PIVOT = f"""
WITH {SPLIT_ROWS}
SELECT name AS class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM r JOIN n USING (class_id) GROUP BY name
"""


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.missing_classes(split_rows(spark, sf_dir), [*NAMES, "unseen"])
    return found.select("split", F.array_join("missing", ",").alias("missing"))


MISSING_CLASSES = f"""
WITH {SPLIT_ROWS},
a AS (SELECT s.split, m.name FROM (SELECT DISTINCT split FROM r) s, (SELECT name FROM n UNION ALL SELECT 'unseen') m)
SELECT split, string_agg(name, ',' ORDER BY name) AS missing FROM a
WHERE NOT EXISTS (SELECT 1 FROM r JOIN n USING (class_id) WHERE r.split = a.split AND n.name = a.name) GROUP BY split
"""


def split_listing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are listed; those with labels have a label file, those with a length that is no multiple of 97 an image."""
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("./images/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    listed = docs.select(g.listed_path(line, F.lit("/set")).alias("path")).withColumn("label_path", g.label_path(F.col("path")))
    images = docs.filter("n_chars % 97 <> 0").select(F.concat(F.lit("/set/images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("/set/labels/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return linkage.listing_gaps(listed, images, files)


SPLIT_LISTING_CHECK = """
SELECT '/set/images/' || doc_id || '.jpg' AS path, 'image' AS missing FROM documents WHERE n_chars % 97 = 0
UNION ALL
SELECT '/set/images/' || doc_id || '.jpg', 'label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all rows each for val and test, in an order that a seed fixes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", linkage.random_order(F.col("doc_id")).alias("key"))
    tenth = int(docs.count() * 0.1)
    val, test = linkage.least_prefixes(docs, [tenth, 2 * tenth])
    split = F.when(linkage.up_to(F.col("key"), val), "val").when(linkage.up_to(F.col("key"), test), "test").otherwise("train")
    return docs.select("doc_id", split.alias("split"))


RANDOM_SPLIT = """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS k FROM documents),
t AS (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS tenth FROM documents)
SELECT doc_id, CASE WHEN k < tenth THEN 'val' WHEN k < 2 * tenth THEN 'test' ELSE 'train' END AS split FROM o, t
"""


def mixed_class_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes whose documents disagree in their label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    by = docs.groupBy(F.md5("text").alias("fine")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("quality").alias("classes"), F.count_distinct("source").alias("sources")
    )
    return by.filter("classes > 1 or sources > 1").select("fine", *[F.col(c).cast("bigint").alias(c) for c in ("n", "classes", "sources")])


MIXED_CLASS_HASHES = """
SELECT md5(text) AS fine, count(*) AS n, count(DISTINCT quality) AS classes, count(DISTINCT source) AS sources
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1 OR count(DISTINCT source) > 1
"""

QUERIES = {
    f.__name__: f
    for f in (
        normalize_vocab, parse_labels, label_paths, recrop_clip_boxes, format_labels, exclude_sources, dedup_cross_source, dedup_two_pass,
        dedup_counters, source_class_report, sign_hash, near_pairs, hamming_links, source_components, assign_splits, split_shares,
        leak_pairs, split_class_pivot, missing_classes, split_listing_check, random_split, mixed_class_hashes,
    )
}
ORACLES = {
    "normalize_vocab": NORMALIZE_VOCAB,
    "parse_labels": PARSE_LABELS,
    "label_paths": LABEL_PATHS,
    "recrop_clip_boxes": RECROP_CLIP_BOXES,
    "format_labels": FORMAT_LABELS,
    "exclude_sources": EXCLUDE_SOURCES,
    "dedup_cross_source": f"WITH {SAMPLES} SELECT source, origin, fine FROM one",
    "dedup_two_pass": f"""WITH {SAMPLES}, r AS (SELECT source, origin, area, row_number() OVER (ORDER BY source, origin) - 1 AS i FROM two WHERE k = 1)
SELECT source || '_' || CASE WHEN i > 99999 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 5, '0') END AS id, source, origin, area FROM r""",
    "dedup_counters": f"""WITH {SAMPLES}
SELECT (SELECT count(*) FROM s) AS input, CAST((SELECT coalesce(sum(n - 1), 0) FROM p WHERE shared) AS BIGINT) AS cross_source,
       CAST((SELECT coalesce(sum(merged - 1), 0) FROM two WHERE k = 1) AS BIGINT) AS within_source, (SELECT count(*) FROM two WHERE k = 1) AS kept,
       (SELECT count(*) FROM s) - (SELECT count(*) FROM two WHERE k = 1) AS dropped""",
    "source_class_report": SOURCE_CLASS_REPORT,
    "sign_hash": f"WITH {HASHES} SELECT id, hash, lpad(format('{{:x}}', hash), 16, '0') AS hex FROM h",
    "near_pairs": f"WITH {PAIRS} SELECT a, b, CAST(distance AS INTEGER) AS distance FROM q",
    "hamming_links": HAMMING_LINKS,
    "source_components": SOURCE_COMPONENTS,
    "assign_splits": f"WITH RECURSIVE {ASSIGNED} SELECT source, group_id, split FROM asg",
    "split_shares": SPLIT_SHARES,
    "leak_pairs": LEAK_PAIRS,
    "split_class_pivot": SPLIT_CLASS_PIVOT,
    "missing_classes": MISSING_CLASSES,
    "split_listing_check": SPLIT_LISTING_CHECK,
    "random_split": RANDOM_SPLIT,
    "mixed_class_hashes": MIXED_CLASS_HASHES,
}
