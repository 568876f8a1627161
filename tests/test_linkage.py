"""Block comparisons against all pairs, components in one task against rounds, selection against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from sigilframe.operators import linkage, theta


def made(spark, n, bits, seed=1, tags=("a", "b", "c")):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(bits) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        h = rnd.choice(base)
        for _ in range(rnd.randint(0, 9)):
            h ^= 1 << rnd.randrange(bits)
        rows.append((i, h, rnd.choice(tags)))
    return rows, spark.createDataFrame(rows, "id long, hash long, tag string").repartition(3)


@pytest.mark.parametrize("threshold", [0, 5, 11, 20])
def test_routes_agree_with_all_pairs(spark, threshold):
    rows, df = made(spark, 300, 62, threshold)
    near = {(i, j, (h ^ g).bit_count()) for i, h, _ in rows for j, g, _ in rows if i < j and (h ^ g).bit_count() <= threshold}
    assert {(r.a, r.b, r.distance) for r in linkage.hamming_pairs(df, threshold).collect()} == near
    want = {}
    for i, j, d in near:
        a, b = sorted((rows[i][2], rows[j][2]))
        if a != b:
            want[a, b, d] = want.get((a, b, d), 0) + 1
    assert {(r.tag_a, r.tag_b, r.distance): r.n for r in linkage.tag_distances(df, threshold).collect()} == want
    links = {(*sorted((rows[i][2], rows[j][2])), rows[x][1], rows[x][2]) for i, j, _ in near if rows[i][2] != rows[j][2] for x in (i, j)}
    got = linkage.links_between(df, threshold).collect()
    assert {(r.source_a, r.source_b, r.hash, r.tag) for r in got} == links and len(got) == len(links)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_blocks_of_any_size(spark, block):
    rows, df = made(spark, 150, 30, block)
    groups = linkage.hash_groups(df)
    whole = {tuple(r) for r in theta.tag_distances(groups, 6, 10_000).groupBy("tag_a", "tag_b", "distance").agg(F.sum("n")).collect()}
    cut = {tuple(r) for r in theta.tag_distances(groups, 6, block).groupBy("tag_a", "tag_b", "distance").agg(F.sum("n")).collect()}
    assert cut == whole and whole
    pairs = [(r.hash_a, r.hash_b) for r in theta.near(df.select("hash").distinct(), 6, block).collect()]
    assert len(pairs) == len(set(pairs))


def test_a_cell_holds_two_blocks_at_most(spark):
    """Rows go to as many cells as there are blocks, and no cell has more than two blocks' rows."""
    df = spark.range(4000).select(F.xxhash64("id").alias("hash"), F.lit("x").alias("tag"), F.lit(1).alias("n"))
    import pyarrow as pa

    seen = theta.cells(df, 0, "rows bigint", lambda rows, pairs: pa.table({"rows": [rows.num_rows]}), 500).collect()
    assert len(seen) == 8 * 9 // 2 and sum(r.rows for r in seen) == 4000 * 8
    assert max(r.rows for r in seen) < 2 * 500 * 1.3


def test_wide_radii_take_blocks_and_tight_ones_bands(spark):
    assert linkage.candidate_share(64, 5) < linkage.WIDE < linkage.candidate_share(63, 13)
    _, df = made(spark, 20, 62)
    plan = lambda t: linkage.near_hashes(df, t)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan(20) and "FlatMapGroupsInArrow" not in plan(5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, hash long, tag string")
    for threshold in (3, 20):
        assert linkage.hamming_pairs(none, threshold).collect() == []
        assert linkage.tag_distances(none, threshold).collect() == []
        assert linkage.links_between(none, threshold).collect() == []


def test_components_in_one_task_equal_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    vertices = spark.createDataFrame([(f"v{i}",) for i in range(60)], "source string")
    edges = spark.createDataFrame([(f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}") for _ in range(35)], "source_a string, source_b string")
    one = {tuple(r) for r in linkage.connected_components(vertices, edges).collect()}
    monkeypatch.setattr(linkage, "MANY_EDGES", 3)
    assert one == {tuple(r) for r in linkage.connected_components(vertices, edges).collect()}
    assert len({g for _, g in one}) > 5


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_selection_equals_sorting(spark, digits):
    df = spark.range(3000).select(linkage.random_order(F.col("id")).alias("key")).cache()
    order = sorted(r.key for r in df.collect())
    ranks = [0, 1, 7, 300, 2999, 3000, 5000]
    for r, p in zip(ranks, linkage.least_prefixes(df, ranks, digits=digits), strict=True):
        assert sorted(x.key for x in df.filter(linkage.up_to(F.col("key"), p)).collect()) == order[:r]


def test_equal_keys_share_a_side(spark):
    df = spark.createDataFrame([("aa",), ("bb",), ("bb",), ("bb",), ("cc",)], "key string")
    got = linkage.least_prefixes(df, [1, 2, 4], digits=1)
    assert [df.filter(linkage.up_to(F.col("key"), p)).count() for p in got] == [1, 4, 4]


def test_selection_does_not_sort(spark):
    df = spark.range(1000).select(linkage.random_order(F.col("id")).alias("key"))
    plan = df.filter(linkage.up_to(F.col("key"), linkage.least_prefixes(df, [100])[0]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan
