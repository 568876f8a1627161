"""The curve's steps, ids against the library, and the pieces against what they must tile."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.llm import curve_packing as cp
from sigilframe.llm.entries import byte_tokenizer, op11_curve_packing, table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokenizer())


def own_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("dims,bits", [(2, 3), (2, 5), (3, 3), (4, 2)])
def test_curve_visits_every_place_in_steps_of_one(dims, bits):
    places = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = cp.hilbert_key(places, bits)
    assert sorted(keys.tolist()) == list(range(1 << dims * bits))
    steps = np.abs(np.diff(places[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


ODD = [
    "", " ", "  ", "   a", "a ", "a  b", "a \n b", "x\n \ny", "a  b", "a  b", "tab\tand \t more", "don't I'll we've 's", "naïve Straße ñandú",
    "漢字 と かな", "🎉 party 🎉🎉", "x<|endoftext|>y", "<|endoftext|>", "12 345 a1b2", "!!! ... --", "\x1c a \x1f b", "a  b", "ﬁ ǅ ʰ ɐ ѣ ", "́ é", "a" * 300 + " " + "b" * 300,
]


def test_ids_equal_the_librarys(library):
    import pyarrow as pa

    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "a", "Wort", "'s", "é", "漢", "7", "!", " ", "\t", "ing"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 60))) for _ in range(400)] + [None]
    for kept in (300_000, 20):
        e = cp.WordEncoder(byte_tokenizer(), kept=kept)
        assert e.ranked
        got = [x.tolist() for x in e.batch(pa.array(texts, pa.string()), 500)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(e.young) <= kept and len(e.old) <= kept


def held(rows, texts, library, size=1024):
    """Every id is in one piece, sequences are gapless and at most `size` long, and none needs padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        for ids in texts[key]:
            at = 0
            while at < len(ids):
                piece = next(p for p in pieces if p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
                pieces.remove(piece)
                assert piece.length > 0
                at += piece.length
            assert at == len(ids)
        assert not pieces
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == size or at & (at - 1) == 0 and at < size
    return by_seq


def test_pieces_of_odd_rows(odd_docs, library):
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(own_ids(library, r.text))
    held(cp.pack_documents(odd_docs, byte_tokenizer()).collect(), texts, library)
    held(cp.pack_documents(odd_docs, byte_tokenizer(), size=64).collect(), texts, library, 64)


def test_query_tiles_every_document(spark, sf_dir, library):
    texts = {r.doc_id: [own_ids(library, r.text)] for r in table(spark, sf_dir, "documents").collect()}
    seqs = held(op11_curve_packing(spark, sf_dir).collect(), texts, library)
    total = sum(len(x[0]) for x in texts.values())
    assert sum(1 for s in seqs.values() if sum(p.length for p in s) == 1024) >= total // 1024 - 4  # at most one open sequence a task


def test_neighbours_are_alike(spark):
    """Sequences of documents along the curve hold one language far more often than by chance."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = cp.pack_documents(docs, byte_tokenizer()).join(docs.select("doc_id", "lang"), "doc_id").collect()

    def purity(order):
        seqs = {}
        for s, r in zip(order, rows, strict=True):
            seqs.setdefault(s, Counter())[r.lang] += r.length
        mixed = [c for c in seqs.values() if sum(c.values()) == 1024]
        return sum(max(c.values()) for c in mixed) / sum(sum(c.values()) for c in mixed)

    owners = {r.doc_id: r.lang for r in rows}
    chance = sum(n * n for n in Counter(owners.values()).values()) / len(owners) ** 2
    got = purity([r.sequence_id for r in rows])
    assert got > 0.9 > chance + 0.3


def test_copies_may_lie_in_many_tasks(spark, library):
    """A key with all rows is split by place, and every copy keeps its pieces."""
    same = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.lit("one text that all rows share " * 40).alias("text"))
    rows = cp.pack_documents(same, byte_tokenizer()).collect()
    ids = own_ids(library, "one text that all rows share " * 40)
    held(rows, {i: [ids] for i in range(400)}, library)


def test_no_rows(no_docs):
    assert cp.pack_documents(no_docs, byte_tokenizer()).collect() == []
