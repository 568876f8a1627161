"""Packing along a space-filling curve.

A document's ids are counted in hashed slots; the square roots of the counts, made to length one, are projected to four
dimensions by fixed signs, squashed to 15 bits each, and read as one place on a Hilbert curve. Documents are sorted by
range of that key, so that each task holds a stretch of the curve, and are laid end to end in its order: neighbours on
the curve fill a sequence together, and one is cut only where a sequence is full. What is left over at the end of a
stretch, less than a sequence, is cut into sequences of powers of two, which need no padding: no token is padding.

Ids are computed once, kept as packed integers in the shared folder (a sort by range reads its rows twice), and dealt
out by key and place, so that rows of one key, copies for example, may lie in many tasks. Sequences are numbered by
stretch and place in it, in the order of the curve; numbers are unique but not gapless.

Words are cut before each single space that no white space follows, which is a boundary of the tokenizer's pattern.
Distinct words of a batch are looked up once (two generations of them are kept by a worker), and encoded by rank where
they are new and Latin; all else, texts with special tokens or runs of white space among it, is encoded by the
tokenizer's own library. Both give the same ids, which the tests compare.

Defined results: null counts as empty, which gives the end id only; a null id is carried like any other value; repeated
rows and equal keys are ordered by their place in the input, and each row has its own pieces; texts of any length are
encoded whole; an empty table gives no pieces; other columns aren't looked at, so clashing names do no harm.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, flat, map_rows, mix, runs, ship

#: Dimensions of the curve, bits of each, slots of a hashed vector.
DIMS, BITS, SLOTS = 4, 15, 1024

#: What the pattern of byte-level tokenizers counts as white space, as a class of RE2.
_WHITE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space at which a text must not be cut: one that white space or the end follows.
_UNEVEN = rf" (?:{_WHITE}|\z)"
#: The letters up to here are the same in every version of Unicode that the libraries know.
_LATIN_END = "ɐ"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts by a byte-level BPE file; `kept` bounds each of the two generations of words remembered."""

    def __init__(self, file: str, kept: int = 300_000, longest: int = 48):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        own = {x: i for x, i in vocab.items() if x not in self.special}
        made = ["".join(x.split(" ") if isinstance(x, str) else x) for x in spec["model"]["merges"]]
        #: Ids are ranks of merges if each merge makes the next id; only then does the rank encoder apply.
        self.ranked = [own.get(x) for x in made] == list(range(len(own) - len(made), len(own)))
        self.coder = None
        if self.ranked:
            ranks = {bytes(letters[c] for c in x): i for x, i in own.items()}
            self.coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.dtype("<u2") if max(vocab.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.kept, self.longest = kept, longest

    def encode(self, unit: str) -> bytes:
        """Ids of a unit, packed. The rank encoder is for Latin letters, which all libraries class alike."""
        if self.coder is not None and (unit.isascii() or max(unit, default="") < _LATIN_END):
            ids = self.coder.encode_ordinary(unit)
        else:
            ids = self.library.encode(unit, add_special_tokens=False).ids
        return np.array(ids, self.width).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        got = self.young.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                got = self.encode(" " + word)
            if len(word) <= self.longest:
                if len(self.young) >= self.kept:
                    self.old, self.young = self.young, {}
                self.young[word] = got
        return got

    def text(self, text: str) -> bytes:
        """Ids of a text cut where it may be, without a batch."""
        if any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        first, *rest = re.split(r" (?=\S)", text)
        return self.encode(first) + b"".join(map(self.word, rest))

    def batch(self, column: pa.Array, size: int = 32 << 20) -> Iterator[np.ndarray]:
        """Ids of each string, null being empty, in runs of about `size` bytes or one longer text."""
        for a, b in runs(flat(column)[1], size):
            yield from self._run(column.slice(a, b - a))

    def _run(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Words are made distinct first, so that each costs one lookup."""
        filled = column.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(filled, _UNEVEN)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(filled, x))
        odd = odd.to_pylist()
        even = filled if not any(odd) else pc.if_else(pa.array(odd), "", filled)
        cut = pc.split_pattern(even, " ")
        at = np.asarray(cut.offsets)
        coded = cut.values.dictionary_encode()
        codes, own = np.asarray(coded.indices), [self.word(x) for x in coded.dictionary.to_pylist()]
        joined = np.frombuffer(b"".join(own), self.width)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.width.itemsize
        begins = np.cumsum(sizes) - sizes
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if odd[i]:
                yield np.frombuffer(self.text(filled[i].as_py()), self.width)
                continue
            first = np.frombuffer(self.encode(coded.dictionary[int(codes[a])].as_py()), self.width)
            mine = codes[a + 1 : b]
            size = sizes[mine]
            total = int(size.sum())
            place = np.arange(total) + np.repeat(begins[mine] - np.cumsum(size) + size, size)
            yield np.concatenate((first, joined[place]))


def signs() -> np.ndarray:
    """One of two signs for each slot and dimension, from hash bits."""
    h = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([np.where(h >> np.uint64(d) & np.uint64(1), 1.0, -1.0) for d in range(DIMS)], 1)


def coordinates(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers of BITS bits in DIMS dimensions for hashed count vectors; zero vectors lie in the middle."""
    root = np.sqrt(vectors)
    length = np.maximum(np.sqrt((root * root).sum(1, keepdims=True)), 1e-12)
    squashed = 1 / (1 + np.exp(-1.7 * (root / length) @ signs()))
    return np.minimum((squashed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve: bits are taken from the top, each cube's axes being turned and mirrored
    so that the curve enters where it left the cube before, then read across the axes with Gray code undone."""
    x = np.array(points, np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            mirrored = (x[d] >> b & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | x[d] >> b & 1
    return key


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def curve_places(df: DataFrame, file: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: the id, its place in the input, its key on the curve, and its ids with the end id, packed."""

    def run(batch: pa.RecordBatch):
        e = encoder(file)
        slot = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
        held, vectors, a = [], [], 0

        def out(b: int) -> pa.RecordBatch:
            keys = hilbert_key(coordinates(np.stack(vectors)))
            rows = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(keys), pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(rows, ["id", "place", "key", "ids"])

        for i, ids in enumerate(e.batch(batch.column(1))):
            vectors.append(np.bincount(slot[ids & 0xFFFF], minlength=SLOTS))
            held.append(np.append(ids, e.width.type(end)).astype(e.width).tobytes())
            if len(held) == 1024:
                yield out(i + 1)
                held, vectors, a = [], [], i + 1
        if held:
            yield out(batch.num_rows)

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("words"), F.monotonically_increasing_id().alias("place"))
    return map_rows(rows, run, f"id {kind}, place bigint, key bigint, ids binary")


class Sequences:
    """Lays documents end to end into sequences of `size` ids and tells the pieces. The open sequence's pieces wait,
    with their ids, until it is full; the last one is cut into powers of two."""

    def __init__(self, size: int, first: int):
        self.size, self.number = size, first
        self.waiting: list[tuple] = []
        self.fill = 0
        self.done: list[tuple] = []

    def add(self, key: object, ids: bytes, n: int) -> None:
        """ids: four bytes each."""
        view, start = memoryview(ids), 0
        while start < n:
            take = min(self.size - self.fill, n - start)
            self.waiting.append((key, start, take, n, view[4 * start : 4 * (start + take)]))
            self.fill += take
            start += take
            if self.fill == self.size:
                self._close()

    def _close(self) -> None:
        at = 0
        for key, start, take, n, ids in self.waiting:
            self.done.append((key, start, take, zlib.crc32(ids), n, self.number, at))
            at += take
        self.waiting, self.fill = [], 0
        self.number += 1

    def finish(self) -> None:
        left, rest = self.waiting, self.fill
        self.waiting, self.fill = [], 0
        while rest:
            room = 1 << rest.bit_length() - 1
            rest -= room
            while room:
                key, start, take, n, ids = left.pop(0)
                fit = min(room, take)
                self.waiting.append((key, start, fit, n, ids[: 4 * fit]))
                if fit < take:
                    left.insert(0, (key, start + fit, take - fit, n, ids[4 * fit :]))
                room -= fit
            self._close()


def pack_documents(
    df: DataFrame, file: str, size: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ensure_checkpoint_dir(df.sparkSession)
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = curve_places(df, file, end, id_col, text_col).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, kinds = encoder(file).width, None
        laid = Sequences(size, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            told, laid.done = laid.done, []
            columns = list(zip(*told, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kinds), *(pa.array(c, pa.int64()) for c in columns[1:])], names
            )

        for batch in batches:
            kinds = batch.column(0).type
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(packed.as_buffer(), width)
                laid.add(key, ids.astype("<u4").tobytes(), len(ids))
            yield out()
        if laid.fill:
            laid.finish()
            yield out()

    laid = placed.repartitionByRange("key", "place").sortWithinPartitions("key", "place").select("id", "ids")
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:])
    return laid.mapInArrow(run, schema).withColumnRenamed("id", id_col)
