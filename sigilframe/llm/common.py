"""Helpers shared by the operators: shipping the package, word hashing, row maps."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
T = TypeVar("T")

#: A-Z to a-z, and every ASCII byte that belongs to no word to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def ship(spark: SparkSession) -> None:
    """Lets the Python workers import this package where they see the driver's folders."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names. Where none is named, one of this machine will do in local mode, as
    in tests; elsewhere others couldn't read it, and a lost executor's work with it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file:///tmp/checkpoints/sigilframe")


def spare(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task under a name. What it kept under others goes: workers outlive a pipeline's
    stages, and would else hold at once what each of them remembered."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]  # type: ignore[return-value]


def forget(but: str = "") -> None:
    """Drops what the worker keeps, but for one name, and gives unused memory back."""
    for name in [n for n in _kept if n != but]:
        del _kept[name]
    pa.default_memory_pool().release_unused()


def map_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, keeps: str = ""
) -> DataFrame:
    """mapInArrow over record batches, which Spark bounds by rows and bytes; no batch waits for another. keeps: the name of
    what fn keeps from task to task, if anything."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of a column one after another, so that only one is held as a Python object."""
    for i in range(len(column)):
        yield column[i].as_py()


def runs(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Rows from and to, of about `size` bytes each; a longer text is a run of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, and where each begins; null is empty."""
    whole = column.cast(pa.large_binary()).fill_null(b"")
    _, places, data = whole.buffers()
    at = np.frombuffer(places, np.int64, len(whole) + 1, 8 * whole.offset)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def fold_words(text: str | None) -> bytes:
    """Lower-cased words, [0-9a-z] and all beyond ASCII, joined by one space."""
    if not text:
        return b""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split())


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 2 * len(_POW)), _BASE, np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW


_POW = np.ones(1, np.uint64)
_CHUNK = 1 << 20


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of space-joined words; works in chunks of about 1 MB."""
    hashes, starts, ends = [], [], []
    at, n = 0, len(joined)
    while at < n:
        stop = n if n - at <= _CHUNK else joined.find(b" ", at + _CHUNK)
        stop = n if stop < 0 else stop
        raw = np.frombuffer(joined, np.uint8, stop - at, at)
        gap = np.flatnonzero(raw == 32)
        s = np.concatenate(([0], gap + 1))
        e = np.concatenate((gap, [len(raw)]))
        size = e - s
        place = np.arange(len(raw)) - np.repeat(s, np.minimum(size + 1, len(raw) - s))
        value = (raw.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 2)[place]
        value[gap] = 0
        h = np.add.reduceat(value, s)
        hashes.append(mix(h + size.astype(np.uint64) * _MIX[1]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop + 1
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; of all words where there are fewer; none of none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    h = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        h = h * _BASE + words[k : n - size + 1 + k]
    return mix(h)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
