import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, columns with names that operators use."""
    rnd = random.Random(7)
    words = "the of and ing tion er on an re he in ed nd ha at en es or ti hi as te et ng".split()
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    long = make(20_000)
    rows = [
        (1, make(80)), (2, None), (3, ""), (4, "   \n\t "), (5, "***"), (6, "***"), (7, "one"), (8, "two words"), (9, long),
        (10, long + " more"), (11, make(70)), (11, None), (None, make(60)), (None, None), (12, "ÜNÏ ß 漢字 🎉 x"), (13, "a" * 50_000),
    ]
    rows += [(20, rows[0][1])] * 3  # repeated rows, and a copy of another
    out = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None]), len(t or "")) for i, t in rows]
    df = spark.createDataFrame(out, DOCS)
    from pyspark.sql import functions as F

    clash = {c: F.lit(1) for c in ("id", "ids", "node", "keys", "row", "token", "bucket", "n_words", "score", "shard", "found", "p", "host", "size")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
