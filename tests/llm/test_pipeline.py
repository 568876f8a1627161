"""run() against the stages' rules by brute force, and the registration."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sigilframe.llm import entries
from sigilframe.llm import language_id as li
from sigilframe.llm import weak_quality as wq

from .test_decontaminate import plain as contamination
from .test_jaccard_forest import plain as classes


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """All of the smallest documents, with copies, nulls and repeated rows."""
    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.filter("doc_id < 12").withColumn("doc_id", F.col("doc_id") + 5000)
    near = docs.filter("doc_id < 12").withColumns({"doc_id": F.col("doc_id") + 6000, "text": F.concat("text", F.lit(" end"))})
    none = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 7000, "text": F.lit(None).cast("string")})
    docs.union(copies).union(near).union(none).union(docs.filter("doc_id = 30")).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = li.train(docs.filter(~li.held_out(F.col("doc_id"))))
    judged = [model.judge(t) for _, t in rows]
    rows = [r for r, (lang, score, told) in zip(rows, judged) if lang != li.UNKNOWN and score >= 0.4 and told >= 0.5]
    ids = [r[0] for r in rows]
    _, scorer = wq.train(docs.filter(F.col("doc_id").isin(ids)))
    make = wq.Features()
    rows = [r for r in rows if scorer.score(make(r[1])) >= 0.25]
    gone = {doc for doc, cls, _ in classes(rows) if doc != cls}
    rows = list(dict.fromkeys(r for r in rows if r[0] not in gone))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r[0] for r in contamination(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(ids := library.encode(t, add_eos=True)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in rows)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want and 100 < len(got) < docs.count()


def test_rows_go_and_not_ids(spark, tmp_path):
    """A row is judged by its own text: its id may be null or another row's."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    docs = [(1, text("a")), (None, text("a") + " end"), (None, text("b")), (2, text("c")), (9, text("c")), (9, text("d")), (9, text("d"))]
    docs += [(None, text("e")), (None, text("e")), (4, text("f")), (4, text("g"))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text("b")), (2, text("f"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages["near_duplicates"](spark, given, str(tmp_path)).checkpoint()
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    left = [docs[0], docs[2], docs[3], docs[5], docs[7], docs[9], docs[10]]
    assert rows(kept) == sorted(left, key=repr)
    clean = stages["decontamination"](spark, kept, str(tmp_path))
    assert rows(clean) == sorted((r for r in left if r not in (docs[2], docs[9])), key=repr)


def test_stages_keep_the_columns(spark, odd_docs, no_docs, small):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs2 = stage(spark, docs, small)
            assert docs2.columns == docs.columns
            docs2.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "encoding"]
    names = set(__spark_entry__.queries())
    assert set(entries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(entries.ORACLES) <= names


def test_stages_keep_columns_with_their_own_names(spark, odd_docs):
    """Columns named like those that stages work with come through unchanged."""
    names = ["__score", "__language", "__row", "___row", "row", "class_id", "contaminated"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    docs = docs.checkpoint()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}-{'none' if r.doc_id is None else r.doc_id}" for n in names], name


def test_a_worker_keeps_one_stage_at_a_time(spark):
    """Workers outlive a pipeline's stages: what one stage remembered goes when the next begins."""
    from sigilframe.llm import common, piece_encoding

    common.forget()
    docs = spark.createDataFrame([(i, " ".join(f"word{i}{c}" for c in "abc"), "xx") for i in range(5)], "doc_id long, text string, lang string")
    model = li.train(docs)
    model.judge("worda wordb")
    assert list(common._kept) == ["language"] and common.kept("language", li.Memory).seen
    common.kept("features", wq.Features)("some words")
    assert list(common._kept) == ["features"]
    codec = piece_encoding.codec(entries.piece_model())
    assert list(common._kept) == [f"pieces {entries.piece_model()}"] and piece_encoding.codec(entries.piece_model()) is codec

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(common._kept)]})

    def remember(batch):
        common.kept("remembered", dict)
        return batch

    one = docs.coalesce(1).select("doc_id")
    common.map_rows(one, remember, "doc_id long").collect()
    common.map_rows(one, lambda b: b, "doc_id long").collect()
    assert [r.n for r in one.mapInArrow(held, "n long").collect()] == [0]
