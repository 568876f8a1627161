"""Against every window of every item looked up in every document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigilframe.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, wide=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(wide, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    found |= {x for x in got if x is not None}
                    hit |= set(range(i, i + n))
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(docs, items, **more):
    out = dc.benchmark_overlap(docs, items, **more)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("bits", [22, 6])
def test_equals_brute_force(spark, bits):
    """Few distinct words, so that shingles repeat; with 64 bits the filter passes nearly all."""
    rnd = random.Random(bits)
    vocab = ["Ab", "b", "c", "é", "D", "x1"]
    make = lambda n: " ".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, make(rnd.choice([0, 1, 2, 3, 5, 13, 14, 30]))) for i in range(14)] + [(3, make(20)), (None, make(16)), (50, None), (51, "...")]
    docs = [(i, make(rnd.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, make(10) + t + make(10)) for i, (_, t) in enumerate(items) if t] + [(200, None), (201, items[4][1]), (201, items[4][1])]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), filter_bits=bits)
    assert got == plain(docs, items)


def test_overlapping_hits_count_once_and_one_twentieth_is_enough(spark):
    passage = [f"p{i}" for i in range(20)]
    filler = lambda n: [f"f{i}" for i in range(n)]
    docs = [(1, " ".join(filler(380) + passage)), (2, " ".join(filler(381) + passage)), (3, " ".join(passage[:12]))]
    out = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string"))
    assert [(r[0], r[2], r[5]) for r in out] == [(1, 20, True), (2, 20, False), (3, 0, False)]


def test_odd_rows(spark, odd_docs, no_docs):
    items = odd_docs.filter("doc_id in (1, 7, 8)").select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("row"), F.lit(2).alias("token"))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    given = [(r.item_id, r.text) for r in items.collect()]
    assert run(odd_docs, items) == plain(rows, given)
    assert run(no_docs, items) == []
    none = run(odd_docs, items.limit(0))
    assert len(none) == len(rows) and not any(r[2] or r[5] for r in none)
