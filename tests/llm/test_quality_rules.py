"""Base measures against regular expressions, sketches against exact quantiles, merging, and verdicts."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sigilframe.llm import quality_rules as qr
from sigilframe.llm.text_measures import measure


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_regular_expressions():
    texts = [
        None, "", " ", "a b c a b c", "a a a a", "x y z", "l1\nl1\n\n \nl1", "#*$ %&|<>", "ü b c \x1c d", "a b c d a b c e a b c",
        "one\ttwo\x0bthree\x0cfour\rfive", "\n".join(["same line here"] * 5), "🎉 漢字 🎉 漢字 🎉",
    ]
    for t in texts:
        m = measure(t)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain(t), t


def test_sketch_quantiles_are_near_and_merge(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.lognormal(1, 1, 4000), np.zeros(500)))
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "v double, part int").withColumn("bin", qr.bin_of(F.col("v")))
    whole = {r.bin: r["count"] for r in df.groupBy("bin").count().collect()}
    merged = Counter()
    for r in df.groupBy("part", "bin").count().collect():
        merged[r.bin] += r["count"]
    assert whole == merged
    for q in (0.25, 0.5, 0.9):
        upto = 0
        for b in sorted(whole):
            upto += whole[b]
            if upto >= q * len(values):
                break
        up, low = spark.range(1).select(qr.upper_edge(F.lit(b)), qr.lower_edge(F.lit(b))).first()
        exact = np.sort(values)[math.ceil(q * len(values)) - 1]
        assert low <= exact * (1 + 1e-9) and exact <= up * (1 + 1e-9) and up <= max(low * 1.0401, qr.FIRST)


def test_thresholds_adapt_to_the_group(spark):
    """A source whose documents all hold symbols keeps them; in another the same document is an outlier."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    text = lambda i, sign: " ".join(word[(i + k) % 24] + str(i) + str(k) + sign for k in range(60))
    rows = [(i, text(i, "#"), "en", "code") for i in range(60)] + [(100 + i, text(i, ""), "en", "prose") for i in range(60)]
    rows += [(999, text(5, "#"), "en", "prose")]
    out = {r.doc_id: r for r in qr.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept for i in range(60)) and all(out[100 + i].kept for i in range(60))
    assert not out[999].base_failed and not out[999].kept


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = qr.apply_quality_rules(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_odd_rows(odd_docs, no_docs):
    rows = qr.apply_quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 5, 7))
    want = sorted(plain(r.text) for r in odd_docs.select("text").collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert qr.apply_quality_rules(no_docs).count() == 0


def test_fences_differ_by_group_and_decide(spark):
    """The fences reject, and not the base rule alone; those of the groups differ, and so do verdicts where sources do."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    own = qr.apply_quality_rules(docs).select("doc_id", "kept")
    base = qr.apply_quality_rules(docs, reach=1e9, errors=1e9).select("doc_id", F.col("kept").alias("base"))
    assert own.join(base, "doc_id").filter("base and not kept").count() > 500
    limits = qr.group_fences(qr.sketches(qr.base_measures(docs)), 30, 3.0)
    assert limits.select("fence.word_length").distinct().count() > 3 and limits.select("fence.dup_lines").distinct().count() > 3
    # code in one source: its symbols are no outliers, and one fence for all would let prose have as many
    code = docs.filter("source = 'src1'").withColumn("text", F.regexp_replace("text", " ", " #"))
    mixed = docs.filter("source <> 'src1'").unionByName(code)
    grouped = qr.apply_quality_rules(mixed).select("doc_id", "kept")
    whole = qr.apply_quality_rules(mixed.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).select("doc_id", F.col("kept").alias("other"))
    differ = grouped.join(whole, "doc_id").filter("kept <> other").join(docs.select("doc_id", "source"), "doc_id")
    assert differ.filter("source = 'src1' and kept").count() > 200


def test_short_documents_are_not_judged_by_one_symbol(spark):
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    text = lambda i: " ".join(word[(i + k) % 24] + str(i) + str(k) for k in range(60))
    rows = [(i, text(i), "en", "prose") for i in range(300)] + [(900, text(900) + " $5", "en", "prose"), (901, text(901) + " $#&" * 12, "en", "prose")]
    out = {r.doc_id: r for r in qr.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept for i in range(300)) and out[900].kept
    assert not out[901].base_failed and not out[901].kept


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(i, n=60, line=0):
    """Words that are unlike those of other documents, in lines of so many words."""
    words = [WORDS[(i * 7 + k * k) % 24] + f"{i}x{k}" for k in range(n)]
    return " ".join(words) if not line else "\n".join(" ".join(words[k : k + line]) for k in range(0, n, line))


def verdicts(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in qr.apply_quality_rules(df, **settings).collect()}


def test_a_rate_and_not_a_count_condemns(spark):
    """Ten symbols in 20,000 words stay; as many in 60 don't, and neither does the rate of those in a long text."""
    rows = [(i, prose(i), "en", "a") for i in range(200)]
    rows += [(500, prose(500, 20_000) + " # $ % & * < > | # $", "en", "a"), (501, prose(501, 60) + " # $ % & * < > | # $", "en", "a"), (502, " ".join(w + "#" * (k % 6 == 0) for k, w in enumerate(prose(502, 20_000).split())), "en", "a")]
    out = verdicts(spark, rows)
    assert all(out[i].kept for i in range(200)) and out[500].kept
    assert not out[501].kept and not out[502].kept and not out[501].base_failed


def test_equal_words_are_inside_their_own_fence(spark):
    """Where all words have three letters, so may those of a very long document."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i, n: " ".join(letters[k % 26] + letters[k // 26 % 26] + letters[(k // 676 + i) % 26] for k in range(n))
    rows = [(i, text(i, 60), "en", "a") for i in range(60)] + [(900, text(3, 17_000), "en", "a")]
    out = verdicts(spark, rows)
    assert all(r.kept for r in out.values())


def test_each_measure_decides(spark):
    """Of 2,000 documents of a source, each measure alone condemns the one that is unlike the others in it."""
    rows = [(i, prose(i, 120, 10), "en", "a") for i in range(2000)]
    base = prose(5000, 120).split()
    odd = {
        "symbols": "\n".join(" ".join(w + "#" for w in base[k : k + 10]) for k in range(0, 120, 10)),
        "dup_lines": "\n".join(WORDS[(k * k) % 24] if k % 2 else base[k] for k in range(120)),
        "repeats": "\n".join(" ".join(base[k : k + 10]) for k in (*range(0, 90, 10),)) + "\n" + " ".join(base[5:30]) + "\n" + " ".join(base[90:95]),
        "word_length": "\n".join(" ".join(w * 3 for w in base[k : k + 10]) for k in range(0, 120, 10)),
    }
    rows += [(9000 + i, t, "en", "a") for i, t in enumerate(odd.values())]
    out = verdicts(spark, rows)
    assert all(out[i].kept for i in range(2000))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = {r.doc_id: r for r in qr.base_measures(df).collect()}
    limits = qr.group_fences(qr.sketches(qr.base_measures(df)), 30, 3.0).first().fence.asDict()
    for i, name in enumerate(odd):
        r = out[9000 + i]
        assert not r.base_failed and not r.kept, name
        m = measured[9000 + i]
        beyond = {k for k, (c, n) in qr.SHARES.items() if m[c] - limits[k] * max(m[n], 1) > 3 * math.sqrt(limits[k] * max(m[n], 1) + 1)}
        assert beyond == {name} or (name == "symbols" and "symbols" in beyond), (name, beyond)


def test_own_fences_differ_from_the_corpus(spark):
    """Sources that are unlike each other: each keeps what is usual there, and one fence for all gives other verdicts."""
    kinds = {"prose": lambda i: prose(i, 100, 10), "code": lambda i: prose(i, 100, 10).replace(" ", " #"), "lists": lambda i: "\n".join(f"{WORDS[k * k % 5]}" if k % 3 else f"w{i}x{k}" for k in range(90))}
    rows = [(1000 * j + i, make(i), "en", source) for j, (source, make) in enumerate(kinds.items()) for i in range(120 if source == "prose" else 40)]
    rows += [(9000, kinds["code"](7), "en", "prose"), (9001, kinds["lists"](7), "en", "prose")]
    own = verdicts(spark, rows)
    whole = verdicts(spark, [(i, t, "en", "x") for i, t, _, _ in rows])
    assert all(r.kept for i, r in own.items() if i < 9000)
    assert not own[9000].kept and not own[9001].kept
    assert sum(own[i].kept != whole[i].kept for i in own) >= 30


def test_query_equals_sql(spark):
    import duckdb

    from sigilframe.llm import entries

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    name = "op3_adaptive_rules"
    df = entries.QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.sql(entries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert rows == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
