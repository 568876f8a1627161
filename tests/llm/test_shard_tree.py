"""The law of the shards, slots, minimal movement, and the tree's descent."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigilframe.llm import shard_tree as sh


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text"))


def test_slots_are_gapless_and_new_shard_takes_only_into_itself(many):
    rows = sh.shard_documents(many).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 40 for r in moved)
    assert 0.6 < len(moved) / (len(rows) / 41) < 1.4
    n = [len(s) for s in slots.values()]
    assert max(n) < 1.35 * min(n)


@pytest.mark.parametrize("shards", [1, 7, 13])
def test_growth_of_any_count(many, shards):
    both = sh.assign_shards(sh.assign_shards(many, shards), shards + 1, base=shards, out="grown")
    moved = both.filter("shard <> grown").select("grown").distinct().collect()
    assert [r.grown for r in moved] == [shards]
    again = sh.assign_shards(sh.assign_shards(many, shards + 1, base=shards), shards + 2, base=shards, out="grown")
    moved = again.filter("shard <> grown").select("grown").distinct().collect()
    assert [r.grown for r in moved] == [shards + 1]


def test_weights(many):
    weights = {3: 3.0}
    counts = Counter(r.shard for r in sh.assign_shards(many, 8, weights).collect())
    others = sum(n for s, n in counts.items() if s != 3) / 7
    assert 2.6 < counts[3] / others < 3.4


def test_a_changed_weight_moves_rows_only_in_its_subtrees(many):
    """Between regions only into the region whose weight grew; in it between racks only into the rack; and so on."""
    both = sh.assign_shards(sh.assign_shards(many, 40), 40, {13: 5.0}, out="heavy")
    moved = [(r.shard, r.heavy) for r in both.filter("shard <> heavy").collect()]
    assert moved and {new // 8 for _, new in moved} == {1}  # shard 13 stands in region 1, shards 8 to 15
    within = [(old, new) for old, new in moved if old // 8 == 1]
    assert within and {new // 4 for _, new in within} == {3}  # and there in the second rack, shards 12 to 15
    assert {new for old, new in within if old // 4 == 3} == {13}
    gone = sh.assign_shards(many, 40, {13: 0.0})
    assert gone.filter("shard = 13").count() == 0 and gone.select("shard").distinct().count() == 39


def plain(key, tree, hashed):
    """One level after the other, in Python: the least draw of the regions, of its racks, of its shards."""
    draw = lambda node, w: -math.log((((hashed[key, node] % 2**64) >> 12) + 0.5) / 2**52) / w
    size = lambda racks: sum(map(len, racks))
    racks = min(tree, key=lambda racks: draw(f"region {racks[0][0]}", size(racks)))
    leaves = min(racks, key=lambda leaves: draw(f"rack {leaves[0]}", len(leaves)))
    return min(leaves, key=lambda s: draw(f"shard {s}", 1))


def test_descent_equals_brute_force(spark):
    tree = sh.Topology().tree(41, 40)
    assert [len(r) for r in tree] == [2] * 5 + [1] and sum(len(x) for r in tree for x in r) == 41
    names = [f"shard {s}" for s in range(41)] + [f"rack {s}" for s in range(0, 41, 4)] + [f"region {s}" for s in range(0, 41, 8)]
    df = spark.range(400).withColumn("way", sh.descend(F.col("id"), tree, {}))
    hashed = {(r.id, n): r[n] for r in df.select("id", *[F.xxhash64("id", F.lit(n)).alias(n) for n in names]).collect() for n in names}
    for r in df.collect():
        assert r.way == plain(r.id, tree, hashed)


def test_eleven_draws_are_made(spark):
    """5 regions, 2 racks and 4 shards: the draws of other branches stand in conditions that are not entered."""
    text = str(sh.descend(F.col("id"), sh.Topology().tree(40), {})._jc.toString()).lower()
    assert text.count("xxhash64") == 5 + 5 * 2 + 40
    top = str(sh.choose(F.col("id"), [f"region {i}" for i in range(5)], [8.0] * 5)._jc.toString()).lower()
    assert top.count("xxhash64") == 5


def test_copies_of_a_row_are_spread(spark):
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    rows = sh.shard_documents(same).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(5000))


def test_odd_rows(odd_docs, no_docs):
    rows = sh.shard_documents(odd_docs).collect()
    texts = odd_docs.select("text").collect()
    assert len(rows) == len(texts)
    data = [(r.text or "").encode() for r in texts]
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len(d) + 16, zlib.crc32(d)) for d in data)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sh.shard_documents(no_docs).count() == 0


def test_no_python(odd_docs):
    plan = sh.shard_documents(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
