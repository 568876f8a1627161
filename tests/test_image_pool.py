"""Image files as a data source: the decoder, two phases, failures, streams; blobs as tables against the array version."""

import glob
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.functions import images
from sigilframe.operators import masks
from sigilframe.sources import image_pool as ip

SCHEMA = "id string, content binary"


def pictures(n, seed=1, channels=(1, 3, 4)):
    rng = np.random.default_rng(seed)
    return {f"i{seed}_{k}": rng.integers(0, 256, (int(rng.integers(1, 9)), int(rng.integers(1, 9)), channels[k % len(channels)]), dtype=np.uint8) for k in range(n)}


def frame(spark, made):
    return spark.createDataFrame([(k, bytearray(images.encode_png(p))) for k, p in made.items()], SCHEMA).repartition(3)


def read(df):
    return {r.id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) for r in df.collect()}


def same(a, b):
    return set(a) == set(b) and all(np.array_equal(a[k], b[k]) for k in a)


def test_pool_gives_back_what_was_written(spark, tmp_path):
    at, first, second = str(tmp_path / "pool"), pictures(20, 1), pictures(7, 2)
    ip.write_pool(frame(spark, first), at)
    ip.write_pool(frame(spark, second), at)
    assert same(read(ip.read_pool(spark, at, files=4)), first | second)
    assert ip.read_pool(spark, at, files=4).rdd.getNumPartitions() >= 7
    ip.write_pool(frame(spark, second), at, overwrite=True)
    assert same(read(ip.read_pool(spark, at)), second)
    assert len(glob.glob(f"{at}/part-*/*.png")) == 7 and not glob.glob(f"{at}/_staging/*")


def test_empty_pool(spark, tmp_path):
    at = str(tmp_path / "pool")
    ip.write_pool(spark.createDataFrame([], SCHEMA), at)
    assert ip.read_pool(spark, at).collect() == [] and ip.read_pool(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    """Lines are filtered as an encoder would, by the definition of each filter."""
    pixels = np.random.default_rng(kind).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    rgb = pixels[:, :, ::-1].astype(int)
    lines = []
    for y in range(6):
        line = bytearray([kind])
        for x in range(5):
            for c in range(3):
                a = rgb[y, x - 1, c] if x else 0
                b = rgb[y - 1, x, c] if y else 0
                d = rgb[y - 1, x - 1, c] if x and y else 0
                nearest = min((abs(a + b - d - v), i, v) for i, v in enumerate((a, b, d)))[2]
                line.append(int(rgb[y, x, c] - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        lines.append(bytes(line))
    plain = images.encode_png(pixels)
    size = int.from_bytes(plain[33:37])
    packed = zlib.compress(b"".join(lines))
    body = plain[:33] + len(packed).to_bytes(4) + b"IDAT" + packed + b"\0\0\0\0" + plain[33 + 12 + size :]
    assert np.array_equal(ip.decode_png(body), pixels)
    assert np.array_equal(ip.decode_png(plain), pixels)


@pytest.mark.parametrize("content", [b"", b"GIF89a", images.encode_png(np.zeros((3, 3, 1), np.uint8))[:40]])
def test_undecodable_files_are_named(spark, tmp_path, content):
    at = str(tmp_path / "pool")
    ip.write_pool(spark.createDataFrame([("bad", bytearray(content))], SCHEMA), at)
    with pytest.raises(Exception, match="cannot decode .*bad.png"):
        ip.read_pool(spark, at).collect()


def test_failed_write_leaves_nothing(spark, tmp_path):
    at, made = str(tmp_path / "pool"), pictures(5)
    ip.write_pool(frame(spark, made), at)
    broken = frame(spark, pictures(9, 3)).union(spark.createDataFrame([("../up", bytearray(b"x"))], SCHEMA))
    with pytest.raises(Exception, match="names no file"):
        ip.write_pool(broken, at)
    assert same(read(ip.read_pool(spark, at)), made)
    assert not glob.glob(f"{at}/_staging/*") and len(glob.glob(f"{at}/part-*/*.png")) == 5


ONCE = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from sigilframe.functions import images
from sigilframe.sources import image_pool as ip
at, mark = sys.argv[1:]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

@F.udf("binary")
def content(i):
    if i == 13 and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost once")
    import numpy as np
    return images.encode_png(np.full((2, 2, 1), i, np.uint8))

rows = spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("id"), content("id").alias("content"))
ip.write_pool(rows, at)
found = {r.id: r.data[0] for r in ip.read_pool(spark, at).collect()}
assert found == {str(i): i for i in range(20)}, found
"""


def test_a_task_that_fails_once(tmp_path):
    """The task runs again, and its first attempt's files are in no part and in no folder."""
    at, mark = str(tmp_path / "pool"), str(tmp_path / "mark")
    subprocess.run([sys.executable, "-c", ONCE, at, mark], check=True, timeout=200, env=os.environ, capture_output=True)
    assert os.path.exists(mark)
    assert len(glob.glob(f"{at}/**/*.png", recursive=True)) == 20 and not glob.glob(f"{at}/_staging/*")


def test_stream_reads_each_commit_once(spark, tmp_path):
    at, out, state = (str(tmp_path / x) for x in ("pool", "out", "state"))

    def run():
        q = ip.stream_pool(spark, at, 3).select("id", "height").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema("id string, height int").parquet(out).collect())

    first, second = pictures(8, 1), pictures(5, 2)
    ip.write_pool(frame(spark, first), at)
    assert run() == sorted(first)
    ip.write_pool(frame(spark, second), at)
    assert run() == sorted(first | second)
    assert run() == sorted(first | second)


def test_hashes_of_read_images(spark, tmp_path):
    """Decoding, hashes and content boxes over files equal those over the arrays that were written."""
    x = np.arange(40)
    made = {"wave": ((np.sin(x / 4)[None, :] + np.cos(x / 5)[:, None]) * 60 + 128).astype(np.uint8)[:, :, None]}
    made["barred"] = np.pad(made["wave"][:, :, 0], ((10, 10), (0, 0)))[:, :, None]
    at = str(tmp_path / "pool")
    ip.write_pool(frame(spark, made), at)
    told = images.with_hashes(ip.read_pool(spark, at).select("id", F.struct("height", "width", "nChannels", "data").alias("image")), 8)
    for r in told.collect():
        grey = made[r.id][:, :, 0]
        assert bytes(r.fine) == images.difference_hash(grey, 16) and bytes(r.coarse) == images.difference_hash(grey, 8)
        assert (r.left, r.top, r.right, r.bottom) == images.content_box(grey)


@pytest.mark.parametrize("least", [1, 40])
def test_blobs_equal_the_array_version(spark, least):
    rng = np.random.default_rng(least)
    held = {m: rng.random((12, 15)) < rng.choice([0.1, 0.3, 0.5, 0.7]) for m in range(30)}
    held |= {90: np.eye(9, dtype=bool), 91: np.eye(9, dtype=bool)[::-1].copy(), 92: np.zeros((3, 3), bool), 93: np.ones((7, 7), bool)}
    cells = [(m, int(y), int(x)) for m, mask in held.items() for y, x in np.argwhere(mask)]
    df = spark.createDataFrame(cells + cells[:50], "mask long, y int, x int").repartition(4)
    got = {r.mask: (r.left, r.top, r.right, r.bottom) for r in masks.largest_blobs(df, least).collect()}
    want = {m: images.largest_blob(mask.astype(float), least) for m, mask in held.items()}
    assert got == {m: b for m, b in want.items() if b is not None and held[m].any()}
