"""Phrase collocations by suffix automata of shards.

A shard is a run of texts of one language, cut into pieces and words. Its generalised suffix automaton, cut off at a
depth, is made level by level: the phrases of k words that end at each place are told apart by their first word and the
node of the k - 1 words after it, which is the node's suffix link. A node with as many ends as one that it is the link
of has the same ends, so both are one state; a state stands for its phrases of the lengths from its shortest to its
longest, all with the state's count. Counts of the phrases of one length are enumerated from the states of each shard
and summed by Spark.

Lengths are counted one after another, as a phrase can't be frequent unless the phrases in it are: what is known to be
frequent goes to the shards as a bit filter (16 bits for each, 2 ** FILTER_BITS bits at most), and nodes that don't
pass aren't extended. What passes by mistake is counted like the rest and has too low a count, so the filter changes
the work and not the result. Words travel as 64-bit hashes of language and word; the table of all words is checked for
two that share a hash, and another seed is taken if there are any, so counts and sums are exact.

A candidate goes if one longer that holds it is frequent enough: of each candidate the phrase without its first word
(its suffix link) and that without its last are told its count, level by level. Scores are computed in decimals of 38
digits. The first rows of each language are picked in buckets first, so no task holds a language.

Defined results: null text counts as empty, null lang as `und`; ids aren't looked at, so repeated rows count as often
as they are there; texts of any length are counted whole (a piece without any separator is held in memory at once);
ties of score and count are in order of the phrase's bytes, those of cuts go to the shortest first part; empty tables
and texts without a frequent phrase give no rows; other columns aren't looked at, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, ship

#: The largest filter is of 2 ** FILTER_BITS bits. A shard has about SHARD bytes, all open shards of a task twice that.
FILTER_BITS, SHARD = 27, 8 << 20
#: Parts of a language that are ranked apart before its first rows are.
BUCKETS = 64

#: A-Z to a-z, separators of pieces to a full stop, tabs to spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256)
)


class Automaton:
    """States of the phrases of up to `depth` words in runs of words; words below 0 are in no phrase.

    alive(k, ends) tells which nodes of k words may be extended; ends are places where each ends first.
    """

    def __init__(self, words: np.ndarray, depth: int, alive: Callable[[int, np.ndarray], np.ndarray] | None = None):
        self.words = words
        levels, at, n = [], words, int(words.max(initial=-1)) + 1
        for k in range(1, depth + 1):
            if k == 1:
                places, key = np.flatnonzero(at >= 0), at[at >= 0]
            else:
                if alive is not None and n:
                    live = alive(k - 1, levels[-1][0])
                    at = np.where((at >= 0) & live[at], at, -1)
                places = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0)) + 1
                key = words[places - k + 1].astype(np.int64) * n + at[places]
            known, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            link = known % n if k > 1 else np.full(len(known), -1)
            levels.append((places[first], counts, link))
            del key
            at = np.full(len(words), -1, np.int32)
            at[places] = inverse
            n = len(known)
            del inverse, places
        self._join(levels)

    def _join(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Nodes with the same ends become one state, which is named after the longest."""
        shortest, parts = np.ones(len(levels[0][0]), np.int64), []
        for k, (ends, counts, link) in enumerate(levels, 1):
            if k > 1:
                same = levels[k - 2][1][link] == counts
                shortest = np.where(same, shortest[link], k)
            absorbed = np.zeros(len(ends), bool)
            if k < len(levels):
                _, above, up = levels[k]
                absorbed[up[above == counts[up]]] = True
            own = ~absorbed
            parts.append((ends[own], np.full(own.sum(), k), shortest[own], counts[own]))
        self.ends, self.longest, self.shortest, self.counts = (np.concatenate(x) for x in zip(*parts, strict=True))

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrases of so many words end first, and how often each occurs."""
        own = (self.shortest <= length) & (self.longest >= length)
        return self.ends[own], self.counts[own]


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """Languages with folded texts (columns lang and text), joined by full stops, of about `size` bytes."""
    open_: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).fill_null("und")
        for lang in pc.unique(langs).to_pylist():
            rows = batch.column(1).filter(pc.equal(langs, lang)).drop_null().cast(pa.large_binary())
            for i in range(len(rows)):
                text = rows[i].as_py().translate(_FOLD)
                open_.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text)
                if held[lang] > size:
                    del held[lang]
                    yield from cut(lang, b".".join(open_.pop(lang)), size)
        while sum(held.values()) > 2 * size:
            lang = max(held, key=held.__getitem__)
            del held[lang]
            yield from cut(lang, b".".join(open_.pop(lang)), size)
    for lang, texts in open_.items():
        yield from cut(lang, b".".join(texts), size)


def cut(lang: str, whole: bytes, size: int) -> Iterator[tuple[str, bytes]]:
    """Parts of at most twice the size, ending at separators, as no phrase lies across; a longer piece stays whole."""
    at = 0
    while len(whole) - at > 2 * size:
        stop = whole.find(b".", at + size)
        if stop < 0:
            break
        yield lang, whole[at:stop]
        at = stop + 1
    yield lang, whole[at:] if at else whole


def coded(shard: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A shard's words as numbers, -1 between pieces, and the words that the numbers stand for."""
    spaced = pa.py_buffer(shard.replace(b".", b" . "))
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, spaced.size])), spaced])
    found = pc.ascii_split_whitespace(whole).values.dictionary_encode()
    words = found.dictionary.cast(pa.large_binary()).to_pylist()
    number = np.arange(len(words), dtype=np.int32)
    for i, w in enumerate(words):
        if w in (b"", b"."):
            number[i] = -2 if w == b"" else -1
    codes = number[np.asarray(found.indices)]
    return codes[codes > -2], words


def sliced(rows: pa.RecordBatch, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches that take little room on their way."""
    for i in range(0, rows.num_rows, most):
        yield rows.slice(i, most)


def word_ids(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of language and word."""
    head = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, head) for w in words), np.uint64, len(words))


def phrase_key(ids: list[np.ndarray]) -> np.ndarray:
    """One number for a phrase: the words' hashes, turned by a bit for each word that follows, and xored."""
    key = np.zeros_like(ids[0])
    for h in ids:
        key = (key << np.uint64(1) | key >> np.uint64(63)) ^ h
    return key


def key_column(names: list[str]) -> Column:
    """phrase_key as a column."""
    key = F.lit(0).cast("long")
    for c in names:
        key = F.shiftleft(key, 1).bitwiseOR(F.shiftrightunsigned(key, 63)).bitwiseXOR(F.col(c))
    return key


def columns(length: int) -> list[str]:
    return [f"h{i}" for i in range(1, length + 1)]


def bit_filter(known: DataFrame, length: int, most: int) -> np.ndarray:
    """A bit for the low bits of each phrase's key, in words of 64: 16 bits a phrase, 2 ** most bits in all at most."""
    bits = min(most, max(16, (16 * known.count()).bit_length()))
    low = key_column(columns(length)).bitwiseAND((1 << bits) - 1)
    held = (
        known.select(low.alias("low"))
        .groupBy(F.shiftrightunsigned("low", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(low & 63 as int)))").alias("held"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[held["word"].to_numpy()] = held["held"].to_numpy()
    return out.view(np.uint64)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64((len(held) << 6) - 1)
    return (held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def all_words(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """Every word of each language with its hash h1 and its count a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches, size):
            codes, words = coded(shard)
            counts = np.bincount(codes[codes >= 0], minlength=len(words))
            there = np.flatnonzero(counts)
            words = [words[i] for i in there]
            rows = [
                pa.array(word_ids(lang, words, seed).view(np.int64)),
                pa.array([lang] * len(words), pa.string()),
                pa.array(words, pa.binary()).cast(pa.string()),
                pa.array(counts[there], pa.int64()),
            ]
            yield from sliced(pa.RecordBatch.from_arrays(rows, ["h1", "lang", "word", "a"]))

    rows = texts.mapInArrow(run, "h1 bigint, lang string, word string, a bigint")
    return rows.repartition("h1").groupBy("h1", "lang", "word").agg(F.sum("a").alias("a"))


def phrase_counts(texts: DataFrame, length: int, filters: list[np.ndarray], size: int, seed: int, least: int) -> DataFrame:
    """Phrases of `length` words that occur `least` times, by the hashes of their words. filters: of what is frequent among
    the phrases of one word, two words and so on."""
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches, size):
            codes, words = coded(shard)
            ids = word_ids(lang, words, seed)

            def hashes(ends: np.ndarray, k: int, codes=codes, ids=ids) -> list[np.ndarray]:
                return [ids[codes[ends - j]] for j in range(k - 1, -1, -1)]

            def alive(k: int, ends: np.ndarray) -> np.ndarray:
                return passes(sent.value[k - 1], phrase_key(hashes(ends, k)))  # noqa: B023

            ends, counts = Automaton(codes, length, alive).phrases(length)
            found = [pa.array(h.view(np.int64)) for h in hashes(ends, length)]
            yield from sliced(pa.RecordBatch.from_arrays([*found, pa.array(counts, pa.int64())], [*columns(length), "a"]))

    names = columns(length)
    rows = texts.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "a"]))
    # rows of a shard are sums already, so they are dealt out at once
    return rows.repartition(*names).groupBy(*names).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    over = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))


def scored(levels: dict[int, DataFrame], length: int) -> DataFrame:
    """Phrases of one length with lang, phrase, a, and l, r and score of the lowest-scoring cut."""
    names = columns(length)
    out = levels[length]
    for i, c in enumerate(names):
        word = levels[1].select(F.col("h1").alias(c), F.col("word").alias(f"w{i}"), F.col("a").alias(f"f{i}"), *(["lang"] if not i else []))
        out = out.join(word, c)
    cuts = []
    for k in range(1, length):
        sides = []
        for side, part in (("l", names[:k]), ("r", names[k:])):
            if len(part) == 1:
                sides.append(F.col(f"f{names.index(part[0])}"))
                continue
            known = levels[len(part)].select(*(F.col(x).alias(c) for x, c in zip(columns(len(part)), part, strict=True)), F.col("a").alias(f"{side}{k}"))
            out = out.join(known, part)
            sides.append(F.col(f"{side}{k}"))
        cuts.append(F.struct(exact_score(F.col("a"), *sides).alias("score"), F.lit(k).alias("k"), sides[0].alias("l"), sides[1].alias("r")))
    lowest = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *(f"w{i}" for i in range(length)))
    return out.select("lang", phrase.alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def unsubsumed(levels: dict[int, DataFrame], length: int, longest: int, share: int) -> DataFrame:
    """Phrases that no longer one that holds them has 100 * f >= share * a."""
    above, names = None, columns(length)
    for k in range(longest, length, -1):
        own = levels[k] if above is None else levels[k].unionByName(above)
        wide = columns(k)
        sides = [own.select(*(F.col(x).alias(c) for x, c in zip(part, columns(k - 1), strict=True)), "a") for part in (wide[1:], wide[:-1])]
        above = sides[0].unionByName(sides[1]).groupBy(*columns(k - 1)).agg(F.max("a").alias("a"))
    if above is None:
        return levels[length]
    out = levels[length].join(above.withColumnRenamed("a", "most"), names, "left")
    return out.filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")


def first_rows(df: DataFrame, by: str, order: list[Column], n: int, buckets: int = BUCKETS) -> DataFrame:
    """The first n rows of each group with their rank. Parts of a group are ranked first, so none is in one task."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(buckets))
    near = df.withColumn("__part", part)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))).filter(F.col("rank") <= n)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= n).drop("__part")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    first: int = 2000,
    shard_size: int = SHARD,
    filter_bits: int = FILTER_BITS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Per language its best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    least: occurrences of a phrase. share: percent of a phrase's occurrences that lie in a longer one which drops it.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    ship(docs.sparkSession)
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        words = all_words(texts, shard_size, seed).checkpoint()
        if words.groupBy("h1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    n = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels, filters = {1: words.filter(F.col("a") >= least)}, []
    for k in range(2, longest + 1):
        filters.append(bit_filter(levels[k - 1], k - 1, filter_bits))
        levels[k] = phrase_counts(texts, k, filters, shard_size, seed, least).checkpoint()
    rows = None
    for k in range(2, longest + 1):
        kept = scored(levels | {k: unsubsumed(levels, k, longest, share)}, k)
        rows = kept if rows is None else rows.unionByName(kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_rows(rows, "lang", order, first)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
