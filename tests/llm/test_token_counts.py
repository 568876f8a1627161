"""Counts equal a quadratic search over all segmentations."""

import random

import public_tokenizers
import pytest

from sigilframe.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def scores():
    return tc.piece_scores(MODEL)


def brute(word, scores):
    """Best (score, minus tokens) of every prefix, from every start."""
    floor = min(scores.values()) - 10_000_000
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + floor, best[end - 1][1] - len(word[end - 1].encode()))]
        for start in range(end):
            if word[start:end] in scores:
                options.append((best[start][0] + scores[word[start:end]], best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_counts_equal_brute_force(scores):
    rnd = random.Random(2)
    parts = ["the", "ing", "▁", "a", "zz", "é", "漢", "🎉", "tion", "q", "\x07", "token", "1"]
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(500)]
    trie = tc.UnigramTrie(scores, nodes=400)  # starts anew many times
    for w in words:
        assert trie.count(w) == trie.plain(w) == brute(w, scores)


def test_prefixes_are_scored_once(scores):
    trie = tc.UnigramTrie(scores)
    calls = []
    extend = trie.extend
    trie.extend = lambda *a: calls.append(1) or extend(*a)
    for w in ("▁under", "▁understand", "▁understanding", "▁under"):
        trie.count(w)
    assert len(calls) == len("▁understanding")


def test_pretokens_keep_every_character():
    for t in ("a b  c\n\nd", " lead", "trail ", "▁x", ""):
        assert "".join(tc.pretokens(t)) == (("▁" + t.replace(" ", "▁")) if t else "")


def test_long_pretokens_stay_off_the_trie(scores):
    trie = tc.UnigramTrie(scores, deepest=16)
    word = "abc" * 400
    assert trie.count(word) == brute(word, scores) and len(trie.forward) == 1


def test_rows(odd_docs, no_docs, scores):
    rows = tc.count_tokens(odd_docs, MODEL).collect()
    texts = odd_docs.select("text").collect()
    assert len(rows) == len(texts)
    trie = tc.UnigramTrie(scores)
    want = sorted(sum(trie.count(w) for w in tc.pretokens(r.text)) for r in texts)
    assert sorted(r.n_tokens for r in rows) == want
    assert tc.count_tokens(no_docs, MODEL).count() == 0
