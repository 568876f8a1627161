"""Pairs of near hashes by comparing blocks, for radii at which no key tells candidates apart.

Groups (hash, tag, n) fall into random blocks, and each pair of blocks is a cell: one task holds two blocks, compares
them by the popcount of their exclusive or in Arrow batches, and sends on what its report makes of the pairs, sums by
tag in general. A row is sent to as many cells as there are blocks, so what is shuffled grows with n * n / block, and
a cell never grows. Groups are distinct, so however many rows share a hash they are one row here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Groups in a block, and rows of one block that are compared with all of another at a time.
BLOCK, CHUNK = 8192, 256

#: left and right places in a cell's rows, and the distance.
Met = tuple[np.ndarray, np.ndarray, np.ndarray]


def met(hashes: np.ndarray, own: np.ndarray, other: np.ndarray, threshold: int) -> Iterator[Met]:
    """Pairs between two blocks, given as places, at most `threshold` bits apart; each once where the blocks are one."""
    same = own is other
    for a in range(0, len(own), CHUNK):
        part = own[a : a + CHUNK]
        d = np.bitwise_count(hashes[part][:, None] ^ hashes[other][None, :])
        near = d <= threshold
        if same:
            near &= np.arange(len(other))[None, :] > np.arange(a, a + len(part))[:, None]
        i, j = np.nonzero(near)
        yield part[i], other[j], d[i, j].astype(np.int64)


def cells(groups: DataFrame, threshold: int, schema: str, report: Callable[[pa.Table, Iterator[Met]], pa.Table], block: int = BLOCK) -> DataFrame:
    """report(rows, pairs) of each cell; rows are hash, tag and n."""
    ship(groups.sparkSession)
    blocks = max(1, -(-groups.count() // block))
    own = F.pmod(F.xxhash64("hash", "tag"), F.lit(blocks)).cast("int")
    cell = lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j"))
    dealt = groups.select("hash", "tag", "n").withColumn("own", own).select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), cell)).alias("cell"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        hashes = rows["hash"].to_numpy().view(np.uint64)
        at, i, j = rows["own"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()
        first = np.flatnonzero(at == i)
        return report(rows, met(hashes, first, first if i == j else np.flatnonzero(at == j), threshold))

    return dealt.select("hash", "tag", "n", "own", "cell.i", "cell.j").groupBy("i", "j").applyInArrow(run, schema)


def near(hashes: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """hash_a < hash_b and distance of distinct hashes; the pairs are the result and listed."""

    def report(rows: pa.Table, pairs: Iterator[Met]) -> pa.Table:
        h, told = rows["hash"].to_numpy(), [(np.empty(0, np.int64),) * 3, *pairs]
        i, j, d = (np.concatenate(x) for x in zip(*told, strict=True))
        return pa.table({"hash_a": np.minimum(h[i], h[j]), "hash_b": np.maximum(h[i], h[j]), "distance": d.astype(np.int32)})

    groups = hashes.select("hash", F.lit(0).alias("tag"), F.lit(1).alias("n"))
    return cells(groups, threshold, "hash_a bigint, hash_b bigint, distance int", report, block)


def _tags(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    coded = pc.dictionary_encode(rows["tag"].combine_chunks())
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def tag_distances(groups: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Per two different tags and distance, the pairs of rows: tag_a < tag_b, distance, n. Cells send sums."""
    kind = groups.schema["tag"].dataType.simpleString()

    def report(rows: pa.Table, pairs: Iterator[Met]) -> pa.Table:
        tags, names = _tags(rows)
        place = np.argsort(np.argsort(np.array(names.to_pylist(), object))) if len(names) else np.empty(0, np.int64)
        n, wide = rows["n"].to_numpy(), len(names)
        sums: dict[int, int] = {}
        for i, j, d in pairs:
            a, b = tags[i], tags[j]
            apart = a != b
            i, j, a, b, d = i[apart], j[apart], a[apart], b[apart], d[apart]
            turned = place[a] > place[b]
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            keys, at = np.unique((a * wide + b) * (threshold + 1) + d, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, n[i] * n[j])
            for k, v in zip(keys.tolist(), total.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
        keys = np.array(sorted(sums), np.int64)
        a, b = keys // (threshold + 1) // max(wide, 1), keys // (threshold + 1) % max(wide, 1)
        return pa.table(
            {
                "tag_a": names.take(pa.array(a)),
                "tag_b": names.take(pa.array(b)),
                "distance": (keys % (threshold + 1)).astype(np.int32),
                "n": pa.array([sums[k] for k in keys.tolist()], pa.int64()),
            }
        )

    return cells(groups, threshold, f"tag_a {kind}, tag_b {kind}, distance int, n bigint", report, block)


def involved(groups: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """Each group with every other tag that it is near to, once a cell: hash, tag, n, other."""
    kind = groups.schema["tag"].dataType.simpleString()

    def report(rows: pa.Table, pairs: Iterator[Met]) -> pa.Table:
        tags, names = _tags(rows)
        wide, keys = max(len(names), 1), np.empty(0, np.int64)
        for i, j, _ in pairs:
            apart = tags[i] != tags[j]
            i, j = i[apart], j[apart]
            keys = np.unique(np.concatenate((keys, i * wide + tags[j], j * wide + tags[i])))
        own = rows.take(pa.array(keys // wide))
        return pa.table({"hash": own["hash"], "tag": own["tag"], "n": own["n"], "other": names.take(pa.array(keys % wide))})

    return cells(groups, threshold, f"hash bigint, tag {kind}, n bigint, other {kind}", report, block)
