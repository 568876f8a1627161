"""Classes and numbers of links against all pairs."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sigilframe.llm import jaccard_forest as jf


def plain(docs):
    """Rows are the vertices; equal sets (equal texts where there is no word) and pairs of 0.8 or more are linked."""
    keys = []
    for i, t in docs:
        own = frozenset(jf.shingle_set(t, 5).tolist())
        keys.append(own or (("null", i) if t is None else ("text", t)))
    n = len(docs)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(n):
        for b in range(a):
            ka, kb = keys[a], keys[b]
            same = ka == kb
            if not same and isinstance(ka, frozenset) and isinstance(kb, frozenset):
                same = 5 * len(ka & kb) >= 4 * len(ka | kb)
            if same:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i in range(n):
        if docs[i][0] is not None:
            least[find(i)] = min(least.get(find(i), docs[i][0]), docs[i][0])
    return sorted(((docs[i][0], least.get(find(i)), links[i]) for i in range(n)), key=repr)


def run(df, **more):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jf.jaccard_classes(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("block", "seed"), [(128, 1), (5, 2)])
def test_equals_all_pairs(spark, block, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    docs = []
    for base in range(6):
        text = [word() for _ in range(120)]
        for _ in range(30 if base == 0 else 4):
            copy = list(text)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
        docs += [(len(docs), " ".join(text))] * 2
    docs += [(500 + i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(30)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), block=block)
    assert got == plain(docs) and sum(x[2] for x in got) > 100


def test_shortening_reaches_the_target():
    k = jf.shortened(24, 6, 4, 0.8, 0.99999)
    recall = lambda k: 1 - (1 - 0.8**4) ** k * (1 - 0.8**6) ** (24 - k)
    assert recall(k) >= 0.99999 > recall(k - 1) and 0 < k < 24
    assert jf.Forest().spare == 24 - k
    assert jf.shortened(4, 8, 4, 0.8, 0.1) == 0 and jf.shortened(2, 8, 4, 0.8, 0.999) == 2


def test_the_largest_branches_stay_at_full_depth(spark):
    """Forty texts share half of their shingles: what they have in common makes large branches, which few nodes need."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    common = [word() for _ in range(200)]
    docs = [(i, " ".join([*common, *(word() for _ in range(150))])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    forest = jf.Forest()
    rows = jf.sketch(jf.numbered(df, "doc_id", "text"), forest, 5).checkpoint()
    pairs = lambda d: d.select("node", F.explode("keys").alias("k")).groupBy("k").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    short, adapted = pairs(rows), pairs(jf.shorten(rows, forest.spare))
    assert adapted < 0.7 * short
    # a branch is at full depth for all of its nodes or for none, and no node has more of them than it may spare
    both = jf.shorten(rows, forest.spare).select("node", F.posexplode("keys").alias("tree", "new"))
    was = rows.select("node", F.posexplode("keys").alias("tree", "old")).join(both, ["node", "tree"]).withColumn("deep", F.col("old") != F.col("new"))
    assert was.groupBy("tree", "old").agg(F.countDistinct("deep").alias("n")).filter("n > 1").count() == 0
    assert was.groupBy("node").agg(F.sum(F.col("deep").cast("int")).alias("n")).filter(F.col("n") > forest.spare).count() == 0


def test_recall_against_all_pairs(spark):
    """The documents with an id divisible by 50 against all others: no link is missing."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets = {r.doc_id: frozenset(jf.shingle_set(r.text, 5).tolist()) for r in docs.collect()}
    got = {r.doc_id: r for r in jf.jaccard_classes(docs).collect()}
    linked = 0
    for a in (d for d in sets if d % 50 == 0):
        near = [b for b, own in sets.items() if b != a and own and 4 * max(len(own), len(sets[a])) <= 5 * min(len(own), len(sets[a])) and 5 * len(own & sets[a]) >= 4 * len(own | sets[a])]
        assert got[a].n_links == len(near)
        assert {got[b].class_id for b in near} <= {got[a].class_id}
        linked += len(near)
    assert linked > 20


def test_many_null_ids_are_joined_by_row(spark):
    docs = [(None, f"text number {i} of its own kind {'x' * i}") for i in range(300)] + [(None, "the same text for two rows"), (None, "the same text for two rows")]
    out = jf.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(out) == 302 and sorted(r.n_links for r in out)[-3:] == [0, 1, 1]


def test_threshold_is_inclusive(spark):
    # nine shingles each side share eight: 8 / 10
    a = [f"a{i}" for i in range(13)]
    b = a[:12] + ["z"]
    docs = [(1, " ".join(a)), (2, " ".join(b))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df) == [(1, 1, 1), (2, 1, 1)]
    assert run(df, threshold=Fraction(81, 100)) == [(1, 1, 0), (2, 2, 0)]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == plain(rows)
    assert run(no_docs) == []


def test_one_of_each_stays(spark, odd_docs):
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (5, "g h")], "doc_id long, text string")
    kept = jf.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert jf.one_of_each(odd_docs).columns == odd_docs.columns
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "another text that is like no other"), (5, "x y z u v w"), (None, "x y z u v w"), (None, "m n o p q r")]
    kept = jf.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((rows[i] for i in (0, 2, 3, 5)), key=repr)
