"""Rank and select against numpy, and the transformation against a plain loop over split lines."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigilframe.llm import fill_middle as fm
from sigilframe.llm.bit_directory import BitDirectory


@pytest.mark.parametrize("n,share", [(0, 0.5), (1, 1.0), (63, 0.3), (64, 1.0), (65, 0.0), (512, 0.5), (513, 0.9), (5000, 0.01), (20_000, 0.4)])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    d = BitDirectory(bits)
    assert d.total == bits.sum()
    assert d.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert d.select(np.arange(1, d.total + 1)).tolist() == np.flatnonzero(bits).tolist()


def plainly(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fm.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["\n", "\n\n\n", "a\n", "\na", "ü\n漢字\n🎉", "x <P> y\nz", "a<S>", "<M>", "<", "<\n<P\n>", "P>\nS>\n<", "a\r\nb\r\n", "\x00\n\x00"]


@pytest.fixture(scope="module")
def lined(spark, odd_docs):
    """Odd rows, texts with marks and halves of marks, and lines at random."""
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(["é", "ab ", "\n", "<", "P>", "🎉"], 200)) for _ in range(60)]
    more = spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(ODD + made)], "doc_id long, text string, lang string, source string, n_chars long")
    return odd_docs.select(more.columns).unionByName(more).repartition(3).cache()


@pytest.mark.parametrize("settings", [{}, {"seed": 9, "rate": 60, "spm_rate": 20}])
def test_equals_plain_loop(lined, settings):
    rows = lined.select("doc_id", "text").collect()
    got = fm.fill_in_middle(lined, **settings).collect()
    want = sorted(((r.doc_id, *plainly(r.doc_id, r.text, **settings)) for r in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_and_exact_restoration(lined):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = lined.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in fm.fim_digests(lined).collect()), key=repr)
    told = [(r, plainly(r.doc_id, r.text)) for r in rows]
    assert got == sorted(((r.doc_id, *x[:4], sha(x[4]), sha(r.text or "")) for r, x in told), key=repr)


def test_long_texts_are_their_own_run(spark):
    """Runs end between texts: one text beyond a run, and many that share one."""
    big = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("line of a text\n"), 700_000).alias("text"))
    got = {r.doc_id: (r.n, r.prefix_chars, r.middle_chars) for r in fm.fim_digests(big).collect()}
    for i in range(3):
        n, _, p, m, _ = plainly(i, "line of a text\n" * 700_000)
        assert got[i] == (n, p, m)


def test_no_rows(no_docs):
    assert fm.fim_digests(no_docs).collect() == []


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    from sigilframe.llm import entries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    name = "op12_rank_select_middle"
    df = entries.QUERIES[name](spark, sf_dir)
    want = con.sql(entries.ORACLES[name])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
