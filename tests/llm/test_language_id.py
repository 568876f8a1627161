"""Brute force, held-out accuracy, backoff to n-grams, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sigilframe.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 250 and np.mean(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_unseen_words_back_off_to_shorter_ngrams(spark):
    rows = [(i, "the thing that thinks through this", "en") for i in range(5)] + [(10 + i, "der schnelle schaum schreibt schon", "de") for i in range(5)]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert "schaumx" not in model.words and model.predict("schaumx")[0] == "de"
    assert model.predict("thinkz THING")[0] == "en"
    # no n-gram of length five to two is known, single letters are
    assert model.predict("ß") == model.predict("ß") and model.predict("ß")[0] in model.languages
    known, by = model.word("thing")
    assert by == li.LONGEST + 1 and known.argmin() == 1 and known[0] > known[1]


def plain(learned, text):
    """The method in a few words: counts of all words and n-grams, backoff from length five to one, the mean distance."""
    cut = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    pieces = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for _, lang in learned})
    count = {(lang, n): Counter() for lang in langs for n in range(6)}
    for t, lang in set(learned):
        for w in cut(t):
            count[lang, 0][w] += 1
            for n in range(1, 6):
                count[lang, n].update(pieces(w, n))
    total = {k: sum(c.values()) for k, c in count.items()}
    penalty = math.log10(max(total.values())) + 1
    far = lambda lang, n, g: -math.log10(count[lang, n][g] / total[lang, n]) if count[lang, n][g] else penalty
    held = lambda n, g: any(count[lang, n][g] for lang in langs)
    sums, words = dict.fromkeys(langs, 0.0), cut(text)
    for w in words:
        n, known = 0, [w] if held(0, w) else []
        if not known:
            for n in range(5, 0, -1):
                known = [g for g in pieces(w, n) if g != " " and held(n, g)]
                if known:
                    break
        for lang in langs:
            sums[lang] += np.mean([far(lang, n, g) for g in known]) if known else penalty
    return min(langs, key=lambda x: (round(sums[x], 9), x)), {x: s / len(words) for x, s in sums.items()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    learned = [(r.text, r.lang) for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    got = {r.doc_id: r for r in li.identify_languages(docs).collect()}
    model = li.train(docs.filter(~li.held_out(F.col("doc_id"))))
    assert set(model.words) == {w for t, _ in learned for w in re.findall(r"[^\W\d_]+", t.lower())}
    for r in rows[:60]:
        best, far = plain(learned, r.text)
        assert got[r.doc_id].lang_pred == best
        words = li.words_of(r.text)
        mean = sum(model.word(w)[0] for w in words) / len(words)
        assert np.allclose(mean, [far[x] for x in model.languages])


def test_every_learned_word_is_in_the_model(spark):
    """More words than any fixed number, and a word of any length."""
    name = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(4))
    long = "xy" * 100
    rows = [(i, " ".join(name(1000 * i + k) for k in range(1000)), "en") for i in range(45)] + [(99, long, "de")]
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.words) == 45_001 and long in model.words
    assert model.grams["xyxyx"] is not None and model.predict(long + "y")[0] == "de"


def test_the_sample_is_bounded_by_texts_and_characters(spark):
    same = [(i, "same words here", "en") for i in range(400)] + [(None, f"other words {chr(97 + i % 26) * (i + 1)}", "en") for i in range(60)]
    docs = spark.createDataFrame(same, "doc_id long, text string, lang string")
    assert li.sample_texts(docs, 500, 10**6, "text", "lang").count() == 61  # equal texts are learned once
    assert li.sample_texts(docs, 3, 10**6, "text", "lang").count() <= 3
    assert 1 <= li.sample_texts(docs, 500, 100, "text", "lang").count() <= 8


def test_marks_are_parts_of_words():
    assert li.words_of("हिन्दी भाषा, e\u0301te\u0301 x2y ½²") == ["हिन्दी", "भाषा", "e\u0301te\u0301", "x", "y"]


def test_stage_rejects_what_no_language_tells(spark):
    rows = [(i, f"the thing that thinks through this {chr(97 + i)}", "en") for i in range(9)]
    rows += [(20, "漢字仮名交 漢字仮名", None), (21, "123 !", "en"), (22, "thinking things through", None), (23, None, "en")]
    kept = li.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in kept} == {*range(9), 22}
    assert {r.lang for r in kept} == {"en"}  # a null language is filled


def test_nothing_to_say(spark):
    model = li.train(spark.createDataFrame([(1, "words here", "en")], "doc_id long, text string, lang string"))
    for t in (None, "", "123 !?", "\n", "½ ²"):
        assert model.predict(t) == (li.UNKNOWN, 0.0)


def test_odd_rows(odd_docs, no_docs):
    rows = li.identify_languages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == li.UNKNOWN}
    assert {2, 3, 4, 5, 6} <= und and 1 not in und and 12 not in und
    assert li.identify_languages(no_docs).count() == 0
    kept = li.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter(F.col("doc_id").isin(2, 3, 4, 5, 6)).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    rows = [(i, f"secret{i} words", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs.filter(~li.held_out(F.col("doc_id"))))
    held = {r.doc_id for r in docs.filter(li.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((f"secret{i}" not in model.words) for i in held)


def test_the_model_is_bounded_over_all_languages(spark):
    """Ten times the languages, a tenth of the texts of each."""
    rows = [(100 * k + i, " ".join(f"{chr(97 + k)}{chr(97 + i)}{chr(97 + j)}" for j in range(25)), f"l{k}") for k in range(20) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = li.sample_texts(df.filter("lang in ('l1', 'l2')"), 1000, 2000, "text", "lang")
    many = li.sample_texts(df, 1000, 2000, "text", "lang")
    size = lambda d: d.agg(F.sum(F.length("text"))).first()[0]
    assert 2000 <= size(few) <= 2000 + 2 * 100 and 2000 <= size(many) <= 2000 + 20 * 100
    assert many.select("lang").distinct().count() == 20
