"""Expectation-maximisation recovers planted accuracies; the classifier agrees with held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sigilframe.llm import weak_quality as wq


def test_em_recovers_planted_rates():
    rng = np.random.default_rng(3)
    n, labellers = 20_000, len(wq.LABELLERS)
    good = rng.random(n) < 0.8
    catch = np.linspace(0.3, 0.8, labellers)  # of junk, by each labeller
    bad = rng.random((n, labellers)) < np.where(good[:, None], 0.01, catch[None, :])
    codes = [wq.pattern(list(np.where(row, wq.BAD, wq.GOOD))) for row in bad]
    values, counts = np.unique(codes, return_counts=True)
    model = wq.fit_labels(values, counts.astype(float))
    assert abs(model.share - 0.8) < 0.02
    told = model.posterior(np.array(codes)) > 0.5
    assert (told == good).mean() > 0.97


def test_patterns_are_reversible():
    for code in (0, 1, 77, 3 ** len(wq.LABELLERS) - 1):
        assert wq.pattern(wq.unpack(code)) == code


def test_verdicts_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = wq.classify_quality(docs).join(labels, "doc_id").select("kept", "quality").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1


def test_odd_rows(odd_docs, no_docs):
    rows = wq.classify_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    blank = {r.doc_id: r for r in rows if r.doc_id in (2, 3, 4)}
    assert all(r.score == 0 and not r.kept for r in blank.values())
    assert len({r.score for r in rows if r.doc_id in (1, 20)}) == 1
    assert wq.classify_quality(no_docs).count() == 0


def test_stage_keeps_columns(odd_docs):
    kept = wq.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.filter(F.col("text").isNull()).count() == 0


def plain_em(votes, rounds=500):
    """Document by document, with the probabilities written out."""
    labellers = range(len(votes[0]))
    good = [(v.count(1) + 1) / (v.count(1) + v.count(-1) + 2) for v in votes]
    for _ in range(rounds):
        rate = {}
        for side in (0, 1):
            weight = [g if side else 1 - g for g in good]
            for k in labellers:
                n = {x: 2 + sum(w for w, v in zip(weight, votes) if v[k] == x) for x in (-1, 1)}
                rate[side, k] = {x: n[x] / (n[-1] + n[1]) for x in n}
        share = (sum(good) + 1) / (len(good) + 2)
        new = []
        for v in votes:
            p = [1 - share, share]
            for side in (0, 1):
                for k in labellers:
                    if v[k]:
                        p[side] *= rate[side, k][v[k]]
            new.append(p[1] / (p[0] + p[1]))
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    return good


def plain_features(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    kinds = []
    for w in words:
        s = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w.decode())
        kinds.append(re.sub(r"(.)\1+", r"\1", s))
    at = Counter()
    slot = lambda kind, b: zlib.crc32(kind + b) % wq.BUCKETS
    for w, k in zip(words, kinds):
        at[slot(b"w", w)] += 1
        at[slot(b"s", k.encode())] += 1
    for a, b in zip(kinds, kinds[1:]):
        at[(slot(b"s", a.encode()) * 31 + slot(b"s", b.encode()) * 17 + 7) % wq.BUCKETS] += 1
    n = len(words)
    out = {k: v / n for k, v in at.items()}
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    recur = {
        b"repeats": len(inside) / n,
        b"runs": sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0,
        b"top": max(Counter(words).values()) / n if n >= 20 else 0,
    }
    for name, v in recur.items():
        out[slot(b"r", name)] = out.get(slot(b"r", name), 0) + 4 * v
    return {k: math.sqrt(v) for k, v in out.items() if v}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model, scorer = wq.train(docs)
    votes = [wq.votes(t) for _, t in rows]
    good = plain_em(votes)
    assert np.allclose(model.posterior(np.array([wq.pattern(v) for v in votes])), good, atol=1e-6)
    got = {r.doc_id: r for r in wq.classify_quality(docs).collect()}
    for doc, text in rows:
        logit = scorer.bias + sum(scorer.weights[k] * v for k, v in plain_features(text).items())
        assert abs(got[doc].score - 1 / (1 + math.exp(-logit))) < 1e-6
        assert got[doc].kept == (got[doc].score >= 0.25)


def test_em_decides_otherwise_than_any_or_most_votes(spark):
    """Accuracies are learned: one bad vote of an accurate labeller counts for more than those of a poor one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(wq.votes(r.text), quality.get(r.doc_id)) for r in docs.select("doc_id", "text").collect()]
    values, counts = np.unique([wq.pattern(v) for v, _ in rows], return_counts=True)
    model = wq.fit_labels(values, counts.astype(float))
    told = dict(zip(values.tolist(), (model.posterior(values) > 0.5).tolist(), strict=True))
    em = np.array([told[wq.pattern(v)] for v, _ in rows])
    any_bad = np.array([wq.BAD not in v for v, _ in rows])
    most = np.array([v.count(wq.GOOD) >= v.count(wq.BAD) for v, _ in rows])
    assert (em != any_bad).sum() > 20 and (em != most).sum() > 500
    known = np.array([y is not None for _, y in rows])
    truth = np.array([y == 1 for _, y in rows])
    right = lambda told: (told == truth)[known].mean()
    assert right(em) > 0.99 and right(em) > right(most) + 0.05
    clean = known & truth
    assert em[clean].mean() > any_bad[clean].mean()


def test_whole_words_and_texts_of_any_length():
    assert wq.shape(b"a1" * 40) != wq.shape(b"a1" * 39)
    vote = lambda words, distinct: wq._variety(wq.measure(" ".join(f"w{i % distinct}" for i in range(words))), b"")
    assert vote(4000, 60) == vote(20_000, 130) == wq.BAD  # a few words over and over are bad at any length
    assert vote(300, 250) == vote(20_000, 12_000) == wq.GOOD


def test_the_sample_has_distinct_texts_and_a_limit(spark):
    rows = [(None, "the same words in every row of this table")] * 500 + [(None, f"row {i} of its own kind") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, scorer = wq.train(docs, sample=10)
    assert np.isfinite(scorer.weights).all()
    assert {r.kept for r in wq.classify_quality(docs).collect()} <= {True, False}
