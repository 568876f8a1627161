"""Language identification, word first with backoff to character n-grams.

A word known in training scores, for each language, minus log10 of its relative frequency there, or a penalty where it
never occurred. An unseen word is cut, with a space at both ends, into n-grams of the longest length; if none of them
is known, the length is reduced by one, down to single characters, and the first length with a known n-gram scores the
word by their mean. The text's distance from a language is the mean over its words; the nearest wins.

The counts come from a bounded sample of the labelled rows: of each language `per_language` distinct texts at most, in
the order of a hash of the text, and no more once its even share of `characters` is passed, which are for all languages
together. So the model, which the driver gathers and sends to the executors, is bounded however many languages there
are. Texts are learned whole, and every word and n-gram of them is in the model: the bounds of the sample are the only
ones. Spark counts, and the model comes to the driver as columns.

A text's score is that of ten words at most: near 1 says that the language is likelier by far, not how long the text is.

Defined results: null texts and texts without a letter are `und` with score 0, as is all text if there was nothing to
learn from; ties go to the first language in alphabetical order; repeated rows get equal results and are learned from
once; extra columns are not looked at; an empty table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, kept, map_rows, ship, spare, texts


def _ranges(kinds: str) -> str:
    """The characters whose general category begins with one of the letters, as the inside of a character class."""
    out, first, last = [], None, None
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in kinds:
            if last != c - 1:
                if first is not None:
                    out.append(f"\\U{first:08x}-\\U{last:08x}")
                first = c
            last = c
    return "".join([*out, f"\\U{first:08x}-\\U{last:08x}"])


#: A letter with the letters and marks that follow it, as vowel signs are part of a word.
WORD = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")
LONGEST = 5
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Memory:
    """Of a worker: sums of runs between blanks that a model has scored. Those of the model before go."""

    of: bytes | None = None  # the model's key, so that the model itself isn't kept alive
    seen: dict[str, int] = {}
    rows: np.ndarray | None = None


@dataclass
class LanguageModel:
    """Words and n-grams have a row each; row r's languages and their gains on the penalty are at starts[r]:starts[r + 1].

    key: of all that the model holds. cells: numbers that are remembered of runs already scored, at most."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    places: np.ndarray
    gains: np.ndarray
    penalty: float
    key: bytes
    cells: int = 1_200_000

    def known(self, w: str) -> tuple[list[int], int]:
        """The rows that tell a word, and the length of their n-grams: 0 if nothing is known of it, more than the
        longest if it is known itself."""
        if (i := self.words.get(w)) is not None:
            return [i], LONGEST + 1
        find = self.grams.get
        padded = f" {w} "
        for n in range(LONGEST, 0, -1):
            if rows := [i for at in range(len(padded) - n + 1) if (i := find(padded[at : at + n])) is not None]:
                return rows, n
        return [], 0

    def distances(self, told: list[tuple[list[int], int]]) -> np.ndarray:
        """Of each word, its mean distance from each language, and whether more than single characters told it."""
        width, sizes = len(self.languages), np.array([len(rows) for rows, _ in told])
        rows = np.array([r for own, _ in told for r in own], np.int64)
        first, many = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        word = np.repeat(np.repeat(np.arange(len(told)), sizes), many)
        gained = np.bincount(word * width + self.places[at], self.gains[at], len(told) * width).reshape(-1, width)
        far = self.penalty + gained / np.maximum(sizes, 1)[:, None]
        return np.column_stack((far, [by > 1 for _, by in told]))

    def word(self, w: str) -> tuple[np.ndarray, int]:
        told = self.known(w)
        return self.distances([told])[0, :-1], told[1]

    def sums(self, chunks: list[str]) -> np.ndarray:
        """Of each run between blanks: the sum of its words' distances from each language, how many of them more than
        single characters tell, and how many there are."""
        words = [WORD.findall(c.lower()) for c in chunks]
        out = np.zeros((len(chunks), len(self.languages) + 2))
        if told := [self.known(w) for own in words for w in own]:
            owner = np.repeat(np.arange(len(chunks)), [len(own) for own in words])
            np.add.at(out, owner, np.column_stack((self.distances(told), np.ones(len(told)))))
        return out

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, the score, and the share of words told by more than single characters."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        width = len(self.languages) + 2
        most = max(1000, self.cells // width)
        memory = kept("language", Memory)
        if memory.of != self.key or len(memory.seen) >= most:
            memory.of, memory.seen, memory.rows = self.key, {}, np.empty((1024, width))
        seen, total, found = memory.seen, np.zeros(width), Counter(text.split())  # no word reaches over a blank
        new = [c for c in found if c not in seen]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            got, first = self.sums(part), len(seen)
            brief = [k for k, c in enumerate(part) if len(c) <= 64][: max(0, most - first)]
            if len(brief) < len(part):  # the others are scored like these, but not remembered
                rest = np.setdiff1d(np.arange(len(part)), brief)
                total += np.array([found.pop(part[k]) for k in rest]) @ got[rest]
            while first + len(brief) > len(memory.rows):
                memory.rows = np.concatenate((memory.rows, np.empty_like(memory.rows)))
            memory.rows[first : first + len(brief)] = got[brief]
            seen.update(zip([part[k] for k in brief], range(first, first + len(brief)), strict=True))
        if found:
            total += np.array(list(found.values()), np.float64) @ memory.rows[[seen[c] for c in found]]
        n = total[-1]
        if not n:
            return UNKNOWN, 0.0, 0.0
        mean = total[:-2] / n
        near = np.power(10.0, -(mean - mean.min()) * min(n, 10))
        best = int(mean.argmin())
        return self.languages[best], float(near[best] / near.sum()), float(total[-2] / n)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def sample_texts(labelled: DataFrame, per_language: int, characters: int, text_col: str, lang_col: str) -> DataFrame:
    """lang and text of the sample. Rows are thinned before anything is sorted, and equal texts are one."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "of").checkpoint()
    languages = counts.count()
    share = characters // max(1, languages)
    if languages <= 10_000:  # a row for each language; else the optimizer decides
        counts = F.broadcast(counts)
    draw = F.xxhash64("text", F.lit(17))
    # twice as many as are wanted, about, as some may be copies
    drawn = usable.join(counts, F.col("lang") == F.col("of")).filter(F.pmod(draw, F.lit(1 << 30)) * F.col("n") < float(2 * per_language) * (1 << 30))
    once = drawn.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("lang").orderBy(draw, "text")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = once.withColumns({"rank": F.row_number().over(order), "before": before})
    return ranked.filter((F.col("rank") <= per_language) & (F.col("before") < share)).select("lang", "text")


def train(
    labelled: DataFrame,
    per_language: int = 1000,
    characters: int = 8_000_000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """per_language: texts learned from in each language; characters: of all languages, an even share of which a language's
    texts may pass once."""

    def count(batch: pa.RecordBatch):
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0), texts(batch.column(1)), strict=True):
            words.setdefault(lang.as_py(), Counter()).update(words_of(text))
        found: Counter = Counter()
        for lang, own in words.items():
            for w, k in own.items():
                found[lang, 0, w] = k
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[lang, n, g] += k
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()),
                pa.array([k[1] for k in found], pa.int32()),
                pa.array([k[2] for k in found], pa.string()),
                pa.array(list(found.values()), pa.int64()),
            ],
            ["lang", "n", "gram", "k"],
        )

    ensure_checkpoint_dir(labelled.sparkSession)
    # a row per batch of the sample for each of its words, so sums are small before they are shuffled
    sample = sample_texts(labelled, per_language, characters, text_col, lang_col)
    counted = map_rows(sample, count, "lang string, n int, gram string, k bigint").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    got = counted.toArrow().sort_by([("n", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
    lang = got["lang"].combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    rank = {name: i for i, name in enumerate(languages)}
    places = np.array([rank[x] for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy(zero_copy_only=False)] if len(got) else np.empty(0, np.int32)
    n, k = got["n"].to_numpy(), got["k"].to_numpy().astype(np.float64)
    total = np.zeros((LONGEST + 1, len(languages)))
    np.add.at(total, (n, places), k)
    penalty = float(np.log10(total.max())) + 1 if len(got) else 1.0
    gains = -np.log10(k / total[n, places]) - penalty
    words: dict[str, int] = {}
    ngrams: dict[str, int] = {}
    starts, last = [], None
    for i, (length, gram) in enumerate(zip(n.tolist(), got["gram"].to_pylist(), strict=True)):
        if (length, gram) != last:
            last = length, gram
            if gram != " ":  # it tells nothing
                (ngrams if length else words)[gram] = len(starts)
            starts.append(i)
    key = hashlib.blake2b("\0".join([*languages, *got["gram"].to_pylist()]).encode("utf-8", "surrogatepass"))
    key.update(n.tobytes() + places.tobytes() + gains.tobytes())
    return LanguageModel(languages, words, ngrams, np.array([*starts, len(gains)], np.int64), places, gains, penalty, key.digest())


def predict_column(df: DataFrame, model: LanguageModel, text: Column) -> Column:
    """struct<lang, score, told> of a text."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double, told double>")
    def predict(column: pa.Array) -> pa.Array:
        m = sent.value
        got = [m.judge(t) for t in texts(column)]
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["lang", "score", "told"])

    # not to be repeated where the result is used twice
    return predict.asNondeterministic()(text)


def held_out(id_col: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, and predicts for all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    got = docs.select("doc_id", predict_column(docs, model, F.col("text")).alias("p"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, score: float = 0.4, told: float = 0.5) -> DataFrame:
    """The documents whose language is known; where lang is null it becomes the predicted one.

    Rejected are texts that are null or have no letter, those of which no language has a score, and those of which more
    than half of the words share with the learned languages single characters at most. If nothing was learned all go.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    own = spare(docs, "__language")
    marked = docs.withColumn(own, predict_column(docs, model, F.col("text")))
    known = (F.col(f"{own}.lang") != UNKNOWN) & (F.col(f"{own}.score") >= score) & (F.col(f"{own}.told") >= told)
    lang = F.coalesce("lang", F.col(f"{own}.lang")).cast(docs.schema["lang"].dataType)
    return marked.filter(known).withColumn("lang", lang).drop(own)
