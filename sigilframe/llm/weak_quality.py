"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. They overlap and differ in accuracy: some are seldom
wrong, others vote bad on good documents too. Their votes fall into at most 3 ** labellers patterns, which Spark counts
over all documents. Expectation-maximisation on these counts begins with the share of good votes and estimates how
often each labeller votes what, when it votes, on good and on bad documents, and the share of good ones. So one bad vote
of an accurate labeller outweighs the good ones of all that miss this kind of junk, and one of a poor labeller doesn't.
The posterior of a document's pattern is the label from which a logistic regression over hashed features of its words
learns. That linear scorer, which sees more than the labellers do, judges every document.

The scorer is trained on the driver on a bounded sample: `sample` distinct texts at most, by a hash of the text.

Defined results: a document without words, or null, has score 0 and is rejected; repeated rows get equal results and
count each in the expectation-maximisation, but once in the sample; an empty table gives an empty result and a scorer
that isn't used; extra columns are not looked at. Whole texts are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_rows, ship, spare, texts
from .text_measures import Measures, measure

GOOD, BAD, NONE = 1, -1, 0
BUCKETS = 4096

_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)
_BLANKS = b" \t\n\r\x0b\x0c"
_LETTERS = _BLANKS + bytes(b for b in range(128, 256)) + bytes(range(65, 91)) + bytes(range(97, 123))
_ODD = frozenset(b"#*$%&|<>~^=+_@/\\{}[]")


def _band(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from another, nothing between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def _share(m: Measures, test: Callable[[bytes], bool]) -> float:
    """Of the words that pass."""
    return float(np.array([test(w) for w in m.distinct])[m.numbers].mean())


def _symbols(m: Measures, data: bytes) -> int:
    return _band(m.n_symbols / m.n_words, 0.02, 0.1)


def _shouting(m: Measures, data: bytes) -> int:
    upper, lower = len(data.translate(None, _UPPER)), len(data.translate(None, _LOWER))
    return NONE if upper + lower < 20 else _band(upper / (upper + lower), 0.1, 0.3)


def _repeats(m: Measures, data: bytes) -> int:
    return NONE if m.n_words < 12 else _band(m.n_repeat_words / m.n_words, 0.1, 0.2)


def _top_word(m: Measures, data: bytes) -> int:
    if m.n_words < 20:
        return NONE
    return _band(int(np.bincount(m.numbers).max()) / m.n_words, 0.12, 0.2)


def _variety(m: Measures, data: bytes) -> int:
    """The logarithm of the vocabulary over that of the words, which changes little with a text's length."""
    if m.n_words < 50:
        return NONE
    return _band(1 - math.log(int(m.numbers.max()) + 1) / math.log(m.n_words), 0.15, 0.25)


def _runs(m: Measures, data: bytes) -> int:
    if m.n_words < 12:
        return NONE
    return _band(float(np.mean(m.numbers[1:] == m.numbers[:-1])), 0.03, 0.1)


def _exclaims(m: Measures, data: bytes) -> int:
    return _band(data.count(b"!") / m.n_words, 0.05, 0.25)


def _wordless(m: Measures, data: bytes) -> int:
    """Words without a letter or digit, such as the bars of a menu."""
    return _band(_share(m, lambda w: len(w) == 1 and not w.isalnum() and w[0] < 128), 0.03, 0.1)


def _letters(m: Measures, data: bytes) -> int:
    """Bytes of words that are neither ASCII letters nor parts of other characters."""
    return _band(len(data.translate(None, _LETTERS)) / max(1, len(data.translate(None, _BLANKS))), 0.08, 0.15)


def _odd_ends(m: Measures, data: bytes) -> int:
    return _band(_share(m, lambda w: w[-1] in _ODD), 0.05, 0.2)


LABELLERS: tuple[Callable[[Measures, bytes], int], ...] = (
    _symbols, _shouting, _repeats, _top_word, _variety, _runs, _exclaims, _wordless, _letters, _odd_ends,
)


def votes(text: str | None) -> list[int]:
    m = measure(text)
    if not m.n_words:
        return [NONE] * len(LABELLERS)
    data = text.encode("utf-8", "surrogatepass")
    return [f(m, data) for f in LABELLERS]


def pattern(vote: list[int]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def unpack(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


@dataclass
class LabelModel:
    """share: of good documents; odds[l, v]: log of P(vote v | good) / P(vote v | bad) of labeller l."""

    share: float
    odds: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        v = np.array([unpack(int(c)) for c in codes]).reshape(-1, len(LABELLERS)) + 1
        logit = np.log(self.share / (1 - self.share)) + self.odds[np.arange(len(LABELLERS)), v].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over the votes cast; not to vote says nothing, as it mostly comes of shortness.

    The first labels are the shares of good votes. Pseudo-documents keep it finite.
    """
    v = np.array([unpack(int(c)) for c in codes]).reshape(-1, len(LABELLERS))
    ayes, noes = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    good = (ayes + 1) / (ayes + noes + 2)
    cast = [BAD + 1, GOOD + 1]
    model = LabelModel(0.5, np.zeros((len(LABELLERS), 3)))
    if not len(codes):
        return model
    for _ in range(rounds):
        rate = []
        for weight in (counts * (1 - good), counts * good):
            tally = np.stack([weight @ (v == x) + 2.0 for x in (BAD, GOOD)], axis=1)
            rate.append(tally / tally.sum(axis=1, keepdims=True))
        odds = np.zeros((len(LABELLERS), 3))
        odds[:, cast] = np.log(rate[1] / rate[0])
        model = LabelModel(float((counts @ good + 1) / (counts.sum() + 2)), odds)
        new = model.posterior(codes)
        done, good = float(np.abs(new - good).max()) < 1e-9, new
        if done:
            break
    return model


_RUN = re.compile(r"(.)\1+")


def shape(word: bytes) -> str:
    """Letters to a and A, digits to 0, runs to one: what remains is how a word is written."""
    s = word.decode("utf-8", "replace")
    s = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s)
    return _RUN.sub(r"\1", s)


class Features:
    """Hashed features of a text: shares of words and their shapes, and of pairs of shapes; how words recur."""

    def __init__(self, kept: int = 100_000):
        self.known: dict[bytes, tuple[int, int]] = {}
        self.kept = kept

    def word(self, w: bytes) -> tuple[int, int]:
        if len(self.known) >= self.kept:
            self.known.clear()
        got = zlib.crc32(b"w" + w) % BUCKETS, zlib.crc32(b"s" + shape(w).encode()) % BUCKETS
        if len(w) <= 64:
            self.known[w] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        m = measure(text)
        if not m.n_words:
            return None
        known = self.known.get
        pairs = np.array([known(w) or self.word(w) for w in m.distinct], np.int64)[m.numbers]
        s = pairs[:, 1]
        where = [pairs.ravel(), (s[:-1] * 31 + s[1:] * 17 + 7) % BUCKETS]
        values = np.bincount(np.concatenate(where), minlength=BUCKETS) / m.n_words
        recur = {
            "repeats": m.n_repeat_words / m.n_words,
            "runs": float(np.mean(m.numbers[1:] == m.numbers[:-1])) if m.n_words > 1 else 0.0,
            "top": int(np.bincount(m.numbers).max()) / m.n_words if m.n_words >= 20 else 0.0,
        }
        for name, value in recur.items():
            values[zlib.crc32(b"r" + name.encode()) % BUCKETS] += 4 * value
        at = np.flatnonzero(values)
        return at, np.sqrt(values[at])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, features: tuple[np.ndarray, np.ndarray] | None) -> float:
        if features is None:
            return 0.0
        at, values = features
        logit = float(self.weights[at] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by Nesterov's method; either side gets half of the weight."""
    if not rows:
        return Scorer(np.zeros(BUCKETS), 0.0)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, values) in enumerate(rows):
        x[i, at] = values
    side = np.array([max((1 - good).sum(), 1e-9), max(good.sum(), 1e-9)])
    weight = ((1 - good) / side[0] + good / side[1]) / 2
    step = 1.0 / (0.25 * float((weight * (x * x).sum(axis=1)).sum()) + decay)
    w = ahead = np.zeros(BUCKETS, np.float32)
    b = ahead_b = 0.0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_b, -40, 40)))
        pull = weight * (p - good)
        new = ahead - step * (x.T @ pull.astype(np.float32) + decay * ahead)
        new_b = ahead_b - step * float(pull.sum())
        push = k / (k + 3)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return Scorer(w.astype(np.float64), float(b))


def train(docs: DataFrame, sample: int = 3000, text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """sample: distinct texts that the scorer is fitted on, at most."""

    def count(batch: pa.RecordBatch):
        return pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in texts(batch.column(0))], pa.int32())], ["code"])

    counted = map_rows(docs.select(text_col), count, "code int").groupBy("code").count().collect()
    codes = np.array([r["code"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], np.float64)
    labels = fit_labels(codes, counts)
    # twice as many as are wanted, about, as some may be copies; all copies of a text are drawn together and become one
    draw = F.xxhash64(F.col(text_col), F.lit(29))
    drawn = docs.select(F.col(text_col).alias("text"), draw.alias("draw")).filter(
        F.pmod("draw", F.lit(1 << 30)) * F.lit(max(1.0, counts.sum())) < float(2 * sample) * (1 << 30)
    )

    def features(batch: pa.RecordBatch):
        make = Features()
        code, at, values = [], [], []
        for t in texts(batch.column(0)):
            got = make(t)
            code.append(pattern(votes(t)))
            at.append(got and got[0].astype(np.int32))
            values.append(got and got[1].astype(np.float32))
        return pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(code, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["draw", "code", "at", "values"],
        )

    # each row holds BUCKETS features at most, and their number is limited, so what comes to the driver is bounded
    made = map_rows(drawn, features, "draw bigint, code int, at array<int>, values array<float>").filter("at is not null")
    once = made.groupBy("draw").agg(*[F.first(c).alias(c) for c in ("code", "at", "values")])
    held = once.orderBy(F.pmod("draw", F.lit(1 << 30)), "draw").limit(sample).collect()
    rows = [(np.array(r["at"], np.int64), np.array(r["values"])) for r in held]
    good = labels.posterior(np.array([r["code"] for r in held], np.int64)) if held else np.empty(0)
    return labels, fit_scorer(rows, good)


def score_column(df: DataFrame, scorer: Scorer, text: Column) -> Column:
    """The scorer's probability that a text is good."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        features = kept("features", Features)
        return pa.array([sent.value.score(features(t)) for t in texts(column)], pa.float64())

    return score(text)


def classify_quality(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """Per row: doc_id, score (probability of a good document), kept: a document goes only at three to one against it."""
    _, scorer = train(docs)
    scored = docs.select("doc_id", score_column(docs, scorer, F.col("text")).alias("score"))
    return scored.withColumn("kept", F.col("score") >= least)


def keep_good(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    _, scorer = train(docs)
    score = spare(docs, "__score")
    marked = docs.withColumn(score, score_column(docs, scorer, F.col("text")))
    return marked.filter(F.col(score) >= least).drop(score)
