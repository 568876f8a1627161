"""Encoding equals the library's, spans cover the text, normalisation equals the library's with offsets."""

import hashlib
import random

import numpy as np
import pytest

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from sigilframe.llm import piece_encoding as pe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "\n", "a", "Hello world", "  two  spaces   ", "line\nbreaks\n\nand\ttabs", "naïve ß Ünïcode 漢字 🎉👍🏽", "▁literal ▁▁ marks▁",
    "x" * 5000, "word " * 3000, "\x00\x01 control", "ends with space ", "\n leading", "a\n\n\n b", "<s> </s> <unk> <0x41>",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n: int) -> list[str]:
    rnd = random.Random(4)
    alphabet = list("abcdefghij   \n.,;éß漢▁🎉\t0123") + ["the ", "ing", "tion "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


def test_ids_and_text_equal_the_library(library):
    c = pe.PieceCodec(MODEL, kept=50)
    assert c.cuts
    for t in TEXTS + random_texts(400):
        ids, said, _, _ = c.encode(t)
        assert ids == library.encode(t, add_eos=True)
        assert said == " ".join(map(str, ids)).encode()
        assert c.decode(ids) == library.decode(ids)


def test_spans_equal_the_library(library):
    c = pe.PieceCodec(MODEL)
    for t in TEXTS + random_texts(100):
        ids, _, _, align = c.encode(t)
        spans = c.spans(ids, align)
        data = t.encode()
        assert (spans[:, 0] <= spans[:, 1]).all() and (len(spans) == 0 or spans[-1].tolist() == [len(data)] * 2)
        want = library.encode(t, return_type="proto")
        for (begin, end), piece in zip(spans[:-1].tolist(), want.pieces, strict=True):
            if not piece.piece.startswith("<0x"):
                assert (begin, end) == (piece.begin, piece.end)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_maps_equal_the_library(rule):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = pb.ModelProto.FromString(theirs.serialized_model_proto())
    mine = pe.Normaliser(model.normalizer_spec)
    assert mine.map.units
    for t in ["①ﬁ  Ａ", "  ｱｲｳ ｶﾞ  ", "Ｈｅｌｌｏ\u3000world", "é é ㍍", "", "   ", "a\tb\u00a0c", "ﷺ x", *random_texts(100)]:
        got, align = mine.normalise(t.encode())
        want, offsets = theirs.Normalize(t, with_offsets=True)
        assert got.decode() == want
        if not want:
            continue
        place = [len(t[:k].encode()) for k in range(len(t) + 1)]
        first = np.cumsum([0] + [len(x.encode()) for x in want])
        assert [int(align[i]) for i in first[:-1]] == [place[o] for o in offsets[: len(want)]]


def test_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(900, None), (901, "twice"), (901, "twice")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, ids string, n_tokens long")
    out = {}
    for r in pe.piece_digests(df, MODEL).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        for r in out[i]:
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(out[901]) == 2 and out[900][0].n_tokens == 1


def test_operator_gives_ids_and_spans(spark):
    df = spark.createDataFrame([(1, "naïve text")], "doc_id long, text string")
    r = pe.encode_pieces(df, MODEL).first()
    data = "naïve text".encode()
    assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == data
    assert len(r.ids) == len(r.begins) == len(r.ends)
    assert pe.encode_pieces(df.limit(0), MODEL).count() == 0
