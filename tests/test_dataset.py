"""Vocabularies, labels, boxes, duplicates, links and splits, one behaviour at a time."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigilframe.functions import geometry as g
from sigilframe.functions.vocabulary import ALIASES, CLASSES, NAMES, normalize_class_name
from sigilframe.operators import dedup, labels, linkage
from sigilframe.session import ordered_index


def test_order_of_classes_is_fixed():
    assert NAMES[0] == "bird" and NAMES[8] == "ram" and NAMES[11] == "tiger" and len(NAMES) == 12
    assert {romaji.lower() for _, romaji, _ in CLASSES} <= set(ALIASES)


def test_spellings(spark):
    rows = [("Hitsuji -ram-",), ("Bird-",), (" TORA ",), ("rabbit",)]
    out = spark.createDataFrame(rows, "raw string").select(normalize_class_name(F.col("raw")).alias("n")).collect()
    assert [r.n for r in out] == ["ram", "bird", "tiger", "hare"]


def test_unknown_spelling_is_an_error(spark):
    with pytest.raises(PySparkException, match="unrecognized class name"):
        spark.createDataFrame([("gassho",)], "raw string").select(normalize_class_name(F.col("raw"))).collect()


def test_label_lines(spark):
    df = spark.createDataFrame([("3.0 0.1 0.2\t0.3  0.4 9",), ("   ",)], "line string")
    out = df.select(labels.parse_label(F.col("line")).alias("p")).collect()
    assert tuple(out[0].p) == (3, 0.1, 0.2, 0.3, 0.4) and out[1].p is None
    with pytest.raises(PySparkException, match="malformed"):
        spark.createDataFrame([("1 0.5 0.5",)], "line string").select(labels.parse_label(F.col("line"))).collect()


def test_class_outside_the_vocabulary_is_an_error(spark):
    vocab = spark.createDataFrame([("a", ["Tori", "I"])], "source string, names array<string>")
    rows = spark.createDataFrame([("a", 0), ("a", 1)], "source string, cls int")
    assert sorted(r.class_id for r in labels.remap_labels(rows, vocab).collect()) == [0, 1]
    with pytest.raises(PySparkException, match="vocabulary"):
        labels.remap_labels(spark.createDataFrame([("a", 7)], "source string, cls int"), vocab).collect()


def test_label_path_changes_the_last_images_folder(spark):
    rows = [("/data/images/cs/train/images/a.b.jpg",), ("/x/images/y.png",)]
    out = spark.createDataFrame(rows, "p string").select(g.label_path(F.col("p")).alias("l")).collect()
    assert [r.l for r in out] == ["/data/images/cs/train/labels/a.b.txt", "/x/labels/y.txt"]


def test_clipped_boxes_stay_inside(spark):
    rnd = random.Random(3)
    rows = [tuple(rnd.uniform(-0.5, 1.5) for _ in range(2)) + tuple(rnd.uniform(0, 1) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "xc double, yc double, w double, h double")
    b = g.box(*[F.col(c) for c in ("xc", "yc", "w", "h")])
    for r in df.select(g.clip_box(b).alias("k")).collect():
        k = r.k
        assert k.w >= 0 and k.h >= 0
        assert -1e-12 <= k.xc - k.w / 2 and k.xc + k.w / 2 <= 1 + 1e-12
        assert -1e-12 <= k.yc - k.h / 2 and k.yc + k.h / 2 <= 1 + 1e-12


SAMPLES = "source string, origin string, area long, fine string, coarse string"


def plain_dedup(rows):
    cross = within = 0
    groups, kept = {}, []
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    survivors = []
    for group in groups.values():
        if len({r[0] for r in group}) > 1:
            best = max(group, key=lambda r: (r[2], r[0]))
            cross += len(group) - 1
            survivors += [r for r in group if r[0] == best[0]]
        else:
            survivors += group
    coarse = {}
    for r in survivors:
        coarse.setdefault((r[0], r[4]), []).append(r)
    for group in coarse.values():
        within += len(group) - 1
        kept.append(max(group, key=lambda r: (r[2], r[1])))
    return {(r[0], r[1]) for r in kept}, cross, within


@pytest.mark.parametrize("seed", range(3))
def test_dedup_equals_loops(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), f"o{i:03d}", rnd.randint(1, 4), f"f{rnd.randint(0, 15)}", f"c{rnd.randint(0, 9)}") for i in range(60)]
    df = spark.createDataFrame(rows, SAMPLES)
    kept, cross, within = plain_dedup(rows)
    assert {(r.source, r.origin) for r in dedup.deduplicate(df).collect()} == kept
    c = dedup.dedup_counters(df).first()
    assert (c.cross_source, c.within_source, c.kept, c.dropped) == (cross, within, len(kept), len(rows) - len(kept))


def test_dedup_of_nothing(spark):
    c = dedup.dedup_counters(spark.createDataFrame([], SAMPLES)).first()
    assert tuple(c) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("threshold", [0, 3, 5, 9, 14, 20])
def test_pairs_equal_brute_force(spark, threshold):
    rnd = random.Random(threshold)
    seeds = [rnd.getrandbits(63) for _ in range(12)]
    rows = [(i, seeds[i % 12] ^ sum({1 << rnd.randrange(63) for _ in range(rnd.randint(0, 12))}), i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, hash long, tag int")
    got = {(r.a, r.b, r.distance) for r in linkage.hamming_pairs(df, threshold).collect()}
    want = {(a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in rows for b in rows if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= threshold}
    assert got == want and (threshold == 0 or want)


def test_bands_keep_the_pigeonhole():
    for t in range(1, 40):
        bands, radius = linkage.plan_bands(63, t)
        assert bands * (radius + 1) > t


def test_components(spark):
    vertices = spark.createDataFrame([(x,) for x in "abcdefgh"], "source string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("f", "e")], "source_a string, source_b string")
    out = {r.source: r.group_id for r in linkage.connected_components(vertices, edges).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}


def test_splits_hold_out_whole_groups(spark):
    groups = spark.createDataFrame([("cs", 1), ("otani", 1), ("vgu", 2), ("x", 3)], "source string, group_id int")
    out = {r.source: r.split for r in linkage.assign_splits(groups, ["otani"], ["vgu"]).collect()}
    assert out == {"cs": "val", "otani": "val", "vgu": "test", "x": "train"}
    with pytest.raises(ValueError):
        linkage.assign_splits(groups, ["nobody"], [])
    with pytest.raises(PySparkException, match="val and test"):
        linkage.assign_splits(groups, ["cs"], ["otani"]).collect()


def test_leaks_are_found_inside_a_source_too(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 0, "a"), (4, (1 << 40) - 1, "b")], "id long, hash long, tag string")
    split = spark.createDataFrame([("a", "train"), ("b", "val")], "source string, split string")
    pairs = linkage.leaking_pairs(rows, split, 5)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (2, 3)}
    with pytest.raises(ValueError):
        linkage.check_no_leakage(pairs)
    assert linkage.check_no_leakage(pairs, allow=True) == 2


def test_ordered_index_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k == r["index"] for r in ordered_index(df, "k").collect())


def test_pivot_has_all_splits(spark):
    rows = spark.createDataFrame([("train", "tiger|bird"), ("train", "tiger")], "split string, classes string")
    out = {r["class"]: (r.train, r.val, r.test) for r in labels.split_class_pivot(rows).collect()}
    assert out == {"tiger": (2, 0, 0), "bird": (1, 0, 0)}
