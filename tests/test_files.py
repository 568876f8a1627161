"""Source trees, images, manifests, lists and patterns on disk."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigilframe.functions import images
from sigilframe.functions.vocabulary import NAMES
from sigilframe.operators import labels
from sigilframe.sources import dataset_tree, patterns, sinks


#: Fixed value: the hash of a picture of waves.
FIXED_WAVES = "9898989898989898"


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = np.random.default_rng(5)
    for source, names in (("cs", "names: [Bird, Boar]"), ("otani", "names: {1: I, 0: Tori, 10: Inu, 2: Uma}"), ("jannat", "names: [Bird-]")):
        for split in ("train", "valid"):
            (root / source / split / "images").mkdir(parents=True)
            (root / source / split / "labels").mkdir()
        (root / source / "data.yaml").write_text(names)
        for i in range(3):
            (root / source / "train" / "images" / f"p{i}.png").write_bytes(png(rng.integers(30, 255, (40, 48, 3))))
        (root / source / "train" / "labels" / "p0.txt").write_text("0 0.5 0.5 0.2 0.2\n\n1.0 0.4 0.4 0.1 0.1 x\n")
        (root / source / "train" / "labels" / "p1.txt").write_text("")
    return str(root)


def test_sources_are_found_and_excluded(spark, tree):
    found = dataset_tree.discover_sources(spark, tree)
    assert {r.source: r.names for r in found.collect()} == {"cs": ["Bird", "Boar"], "otani": ["Tori", "I", "Uma", "Inu"]}
    mapped = {(r.source, r["index"]): r.name for r in labels.class_map(found).collect()}
    assert mapped["otani", 3] == "dog"


def test_samples_join_images_and_labels(spark, tree):
    rows = dataset_tree.read_samples(spark, tree).filter("source = 'cs'").orderBy("origin").collect()
    assert [r.n_boxes for r in rows] == [2, 0, None]
    assert rows[0].boxes[1].cls == 1 and rows[0].split == "train"
    status = dataset_tree.read_samples(spark, tree).select(labels.label_status(F.col("n_boxes")).alias("s")).groupBy("s").count()
    assert {r.s: r["count"] for r in status.collect()} == {"kept": 3, "empty_label": 3, "unlabeled": 3}


def test_image_hashes(spark, tree):
    scanned = dataset_tree.scan_images(spark, tree, decode=True)
    out = images.with_hashes(scanned, 8).collect()
    assert len(out) == 9 and all(len(r.fine) == 32 and len(r.coarse) == 8 for r in out)
    assert len({r.fine for r in out}) == 9
    assert all((r.left, r.top, r.right, r.bottom) == (0, 0, 48, 40) and r.width == 48 for r in out)


def test_cropped_images(spark, tmp_path):
    pixels = np.random.default_rng(2).integers(60, 255, (30, 40, 3))
    pixels[:6] = pixels[-4:] = 0
    (tmp_path / "s" / "train" / "images").mkdir(parents=True)
    (tmp_path / "s" / "train" / "images" / "a.png").write_bytes(png(pixels))
    rows = dataset_tree.scan_images(spark, str(tmp_path), decode=True).withColumn("id", F.lit("s_00000"))
    sinks.write_images(rows, f"{tmp_path}/pool")
    out = spark.read.parquet(f"{tmp_path}/pool").first()
    (tmp_path / "t" / "train" / "images").mkdir(parents=True)
    (tmp_path / "t" / "train" / "images" / "b.png").write_bytes(bytes(out.content))
    back = dataset_tree.scan_images(spark, f"{tmp_path}/t/..", decode=True).filter("path like '%b.png'").first().image
    got = np.frombuffer(back.data, np.uint8).reshape(back.height, back.width, 3)[:, :, ::-1]
    assert out.id == "s_00000" and (got == pixels[6:26]).all()


def test_undecodable_image_is_an_error(spark, tmp_path):
    (tmp_path / "s" / "train" / "images").mkdir(parents=True)
    (tmp_path / "s" / "train" / "images" / "a.png").write_bytes(b"no image")
    with pytest.raises(PySparkException):
        dataset_tree.scan_images(spark, str(tmp_path), decode=True).collect()


def test_hash_survives_rescaling_and_tells_apart():
    rng = np.random.default_rng(1)
    small = np.kron(rng.integers(0, 255, (16, 16)), np.ones((4, 4))).astype(np.uint8)
    large = np.kron(small, np.ones((2, 2))).astype(np.uint8)
    bits = lambda h: np.unpackbits(np.frombuffer(h, np.uint8))
    a, b = (bits(images.difference_hash(x, 8)) for x in (small, large))
    assert (a != b).sum() <= 4
    other = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    assert (a != bits(images.difference_hash(other, 8))).sum() > 8
    assert images.difference_hash(small, 16) == images.difference_hash(small, 16)


def test_resampling_by_its_definition():
    """Weights written out cell by cell, in fixed point, and the rounding between the passes."""
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (23, 37)).astype(np.uint8)

    def line(values, to):
        scale = len(values) / to
        reach = max(scale, 1.0)
        out = []
        for i in range(to):
            centre = (i + 0.5) * scale
            span = range(max(int(centre - 3 * reach + 0.5), 0), min(int(centre + 3 * reach + 0.5), len(values)))
            sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
            w = [sinc((k - centre + 0.5) / reach) * sinc((k - centre + 0.5) / reach / 3) if -3 <= (k - centre + 0.5) / reach < 3 else 0.0 for k in span]
            fixed = [int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
            total = sum(f * int(values[k]) for f, k in zip(fixed, span))
            out.append(min(255, max(0, (total + 2**21) >> 22)))
        return out

    rows = [line(r, 9) for r in grey]
    want = np.array([line(c, 8) for c in np.array(rows).T]).T
    assert (images.resample(grey, 9, 8) == want).all()
    assert (images.resample(grey, 37, 23) == grey).all()


def test_hashes_are_fixed():
    y, x = np.mgrid[0:40, 0:50]
    ramp, waves = (x * 5).astype(np.uint8), ((np.sin(x / 4.0) + np.cos(y / 5.0)) * 60 + 128).astype(np.uint8)
    assert images.difference_hash(ramp, 8) == b"\xff" * 8 and images.difference_hash(ramp[:, ::-1], 8) == b"\0" * 8
    assert images.difference_hash(waves, 8).hex() == FIXED_WAVES


def test_largest_blob_equals_flood_fill():
    rng = np.random.default_rng(9)
    for share in (0.1, 0.3, 0.4, 0.5, 0.9):
        mask = rng.random((30, 41)) < share
        left, best = {tuple(p) for p in np.argwhere(mask)}, []
        for p in map(tuple, np.argwhere(mask)):
            todo, blob = [p] if p in left else [], []
            left.discard(p)
            while todo:
                y, x = todo.pop()
                blob.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            best = blob if len(blob) > len(best) else best
        ys, xs = zip(*best)
        assert images.largest_blob(mask.astype(float)) == (min(xs), min(ys), max(xs) + 1, max(ys) + 1)
    assert images.largest_blob(np.eye(20)) is None


def test_content_box():
    img = np.full((64, 64), 200, np.uint8)
    img[:10] = img[-10:] = 0
    assert images.content_box(img) == (0, 10, 64, 54)
    img[3, 5] = 255  # a stray bright pixel
    assert images.content_box(img) == (0, 10, 64, 54)
    assert images.content_box(np.zeros((8, 9), np.uint8)) == (0, 0, 9, 8)
    assert images.content_box(np.full((8, 9), 40, np.uint8)) == (0, 0, 9, 8)


def test_label_files_and_manifest(spark, tmp_path):
    box = "struct<class_id:int,box:struct<xc:double,yc:double,w:double,h:double>>"
    rows = [("b", "2", [(1, (0.95, 0.5, 0.2, 0.2)), (3, (1.5, 0.5, 0.1, 0.1))]), ("a", "1", [(0, (0.5, 0.5, 0.2, 0.2))])]
    out = sinks.label_files(spark.createDataFrame(rows, f"source string, origin string, boxes array<{box}>")).orderBy("id").collect()
    assert [(r.id, r.n_boxes, r.classes, r.clipped_boxes) for r in out] == [("a_00000", 1, "bird", 0), ("b_00001", 1, "boar|dragon", 2)]
    assert out[1].text == "1 0.925000 0.500000 0.150000 0.200000"
    manifest = spark.createDataFrame([("a_00000", "a", "1", "images/a.jpg", 4, 5, 1, "bird", "ff")], dataset_tree.MANIFEST)
    sinks.write_manifest(manifest, f"{tmp_path}/m")
    assert dataset_tree.read_manifest(spark, f"{tmp_path}/m").collect() == manifest.collect()
    sinks.write_manifest(manifest.limit(0), f"{tmp_path}/none")
    assert dataset_tree.read_manifest(spark, f"{tmp_path}/none").count() == 0


def test_split_lists(spark, tmp_path):
    rows = spark.createDataFrame([("images/a.jpg", "train"), ("images/b.jpg", "val")], "image string, split string")
    sinks.write_splits(rows, f"{tmp_path}/lists")
    assert {r[0] for r in spark.read.text(f"{tmp_path}/lists/list=val").collect()} == {"./images/b.jpg"}
    (tmp_path / "val.txt").write_text("./images/b.jpg\n")
    out = dataset_tree.read_listing(spark, f"{tmp_path}/val.txt").first()
    assert out.path == f"{tmp_path}/images/b.jpg" and out.label_path == f"{tmp_path}/labels/b.txt"
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(ValueError):
        dataset_tree.read_listing(spark, f"{tmp_path}/none.txt")
    assert "nc: 12" in sinks.split_yaml({"train.txt", "val.txt", "test.txt"}, "/d")
    with pytest.raises(FileNotFoundError):
        sinks.split_yaml({"train.txt"}, "/d", "random")


def test_grouping_document(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "source string, group_id string")
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val")], "source string, split string")
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], "id int, tag string")
    text = sinks.grouping_document(5, groups, split, rows).first().value
    assert text == '{"threshold":5,"groups":[["a","b"],["c"]],"assignment":{"a":"train","b":"train","c":"val"},"counts":{"a":1,"c":2}}'


def test_hash_cache_computes_new_keys_only(spark, tmp_path):
    asked = []

    def compute(rows):
        asked.append(rows.count())
        return rows.select("key", (F.length("key") * 2).alias("hash"))

    one = spark.createDataFrame([("k",), ("kk",)], "key string")
    two = spark.createDataFrame([("k",), ("kkk",)], "key string")  # as many rows, other content
    assert {tuple(r) for r in dataset_tree.cached_hashes(spark, one, f"{tmp_path}/h", compute).collect()} == {("k", 2), ("kk", 4)}
    assert {tuple(r) for r in dataset_tree.cached_hashes(spark, two, f"{tmp_path}/h", compute).collect()} == {("k", 2), ("kkk", 6)}
    assert asked == [2, 1]


def test_pattern_files(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("﻿element,jutsu,sign1,sign2,sign3\nFire, Short ,TIGER,snake,\n\n,,,,\n,Long,tiger,snake,ram\n", encoding="utf-8")
    got = patterns.load_patterns(spark, f"{tmp_path}/p.csv", NAMES)
    assert [(p.name, p.element, p.signs) for p in got] == [("Short", "Fire", ("tiger", "snake")), ("Long", "", ("tiger", "snake", "ram"))]
    assert "'Long' can never match" in capsys.readouterr().out
    (tmp_path / "p.yaml").write_text("jutsu:\n- {name: A, english: Water, signs: [Ox, hare]}\n")
    assert patterns.load_patterns(spark, f"{tmp_path}/p.yaml", NAMES)[0].signs == ("ox", "hare")
    (tmp_path / "bad.csv").write_text("x,Bad,gassho,\n")
    with pytest.raises(PySparkException, match="unknown signs"):
        patterns.load_patterns(spark, f"{tmp_path}/bad.csv", NAMES)
    (tmp_path / "none.csv").write_text("element,jutsu,sign1\n")
    with pytest.raises(ValueError):
        patterns.load_patterns(spark, f"{tmp_path}/none.csv", NAMES)


def test_pattern_lines_never_meet_in_one_task(spark):
    """The header is told by the least place, without a window over all lines; its cells are no unknown signs later on."""
    from sigilframe.operators import sequences

    made = [(3, "\ufeffelement,jutsu,sign1"), (2, " ,,"), *((i, f"x,p{i},ox,hare" + ",ram" * (i % 2)) for i in range(4, 40)), (40, "element,jutsu,dog")]
    out = patterns.parse_pattern_lines(spark.createDataFrame(made, "place int, line string"), NAMES)
    assert sorted(r.place for r in out.collect()) == list(range(4, 41))
    assert {r.name for r in sequences.unreachable(out).collect()} == {f"p{i}" for i in range(5, 40, 2)}
    assert "Window" not in out._jdf.queryExecution().toString()


def test_class_order_is_checked():
    dataset_tree.check_class_order(list(NAMES), NAMES)
    with pytest.raises(ValueError):
        dataset_tree.check_class_order(sorted(NAMES, reverse=True), NAMES)
