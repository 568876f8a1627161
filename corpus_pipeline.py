"""A corpus pipeline of five stages, each over all that the one before it kept.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents. Stages judge rows,
not ids: docs are as the stage before has written them, so that a row has the same number whenever they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigilframe.llm.common import ensure_checkpoint_dir
from sigilframe.llm.decontaminate import keep_clean
from sigilframe.llm.entries import piece_model
from sigilframe.llm.jaccard_forest import one_of_each
from sigilframe.llm.language_id import keep_identified
from sigilframe.llm.piece_encoding import piece_digests
from sigilframe.llm.weak_quality import keep_good


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; a null lang becomes the predicted one.

    Null, empty and letterless texts go, and those whose words share little with the learned languages. Ids aren't
    looked at but for what is learned from, so repeated rows and null ids are judged by their texts alike. Of an empty
    table, and of one without any lang to learn from, nothing stays. Other columns are kept as they are.
    """
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go.

    Texts without words, null ones among them, are rejected; a score that equals the bound stays. Repeated rows have
    equal scores and share a fate. An empty table stays empty; other columns are kept as they are.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by links of Jaccard similarity 0.8, one with the least id stays; rows without text all stay.

    Rows are judged and not ids: rows that repeat an id, or have none, have each the fate of their own text, and of
    equal rows one stays. A null id comes last. Texts without words are near equal texts only. An empty table stays
    empty; other columns are kept as they are.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with benchmark windows on a twentieth of their words or more.

    Rows are judged and not ids, which may repeat or be null. Null and empty texts have no words and stay; so does all
    if the benchmark is empty. An empty table stays empty; other columns are kept as they are.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests: a row for each row, also of null (as empty), repeated and very
    long texts and null ids; none of an empty table. Other columns are not carried on."""
    return piece_digests(docs, piece_model())


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No stage before the last can be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder and read by the next."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
