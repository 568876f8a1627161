"""N-gram Jaccard join by a MinHash LSH forest.

A document's set is that of its shingles (runs of five words). Documents with the same set are one node. Each tree of
the forest orders nodes by a label of minhashes; nodes whose labels share a prefix meet in one branch of the tree's
prefix trie. A node's matched prefixes start at full depth. They are shortened one tree after the other, where it costs
least: first in the trees where the shorter prefix is shared by the fewest nodes, until a partner at the threshold meets
the node in some tree with the target probability. So each node leaves its largest branches at full depth, and a branch
stays so if all nodes of it leave it; where one needs it, all of it is compared. Pairs that meet are compared exactly,
on sets taken from the whole texts.

A branch may hold any number of nodes. Branches with the same members are compared once. Large ones are cut into
blocks by hash, and every pair of blocks is compared in its own task, so no pair is left out and no task gets a whole
branch. A pair is counted in the first tree where it meets. Compared pairs are not emitted: a block gives each node
its number of links and the root of its local component.

Defined results: a document of fewer than five words has one shingle, of all its words. Documents without words are
linked only to documents with the same text; null texts are alone. n_links counts the other rows at or above the
threshold, class_id is the least id of the rows connected by links. Repeated rows are copies of each other. Extra
columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_long, ensure_checkpoint_dir, fold_words, forget, map_rows, mix, shingle_hashes, ship, spare, texts, word_hashes

WORDS, THRESHOLD = 5, Fraction(4, 5)


def shortened(trees: int, deepest: int, shortest: int, similarity: float, target: float) -> int:
    """Trees in which a node's prefix must be shortened for the recall to reach the target; all if it can't."""
    for k in range(trees):
        if 1 - (1 - similarity**shortest) ** k * (1 - similarity**deepest) ** (trees - k) >= target:
            return k
    return trees


def shingle_set(text: str | None, words: int) -> np.ndarray:
    h, _, _ = word_hashes(fold_words(text))
    return np.unique(shingle_hashes(h, words))


def node_of(doc_id, text: str | None, own: np.ndarray) -> bytes:
    """Sixteen bytes that stand for the set; for the text where there is no word; for the row if that is null."""
    what = b"s" + own.tobytes() if len(own) else b"n" + repr(doc_id).encode() if text is None else b"t" + text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(what, digest_size=16).digest()


class Forest:
    """trees; minhashes of a full label and of the shortest prefix. The defaults shorten 20 trees and leave 4."""

    def __init__(self, trees: int = 24, deepest: int = 6, shortest: int = 4, target: float = 0.99999, similarity: float = float(THRESHOLD)):
        self.trees, self.deepest, self.shortest = trees, deepest, shortest
        self.spare = trees - shortened(trees, deepest, shortest, similarity, target)
        total = trees * deepest
        seeds = mix(np.arange(1, 2 * total + 1, dtype=np.uint64))
        self.xor, self.times = seeds[:total], seeds[total:] | np.uint64(1)

    def labels(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, a number for the tree and the shortest prefix of the node's label, and one for the rest."""
        least = np.full(len(self.xor), ~np.uint64(0))
        for i in range(0, len(own), 1024):
            part = (own[i : i + 1024, None] ^ self.xor[None, :]) * self.times[None, :]
            np.minimum(least, part.min(axis=0), out=least)
        spread = mix(least + np.arange(len(least), dtype=np.uint64)).reshape(self.trees, self.deepest)
        total = lambda part: mix(part.sum(axis=1, dtype=np.uint64) + np.arange(self.trees, dtype=np.uint64))
        return total(spread[:, : self.shortest]), total(spread[:, self.shortest :]) >> np.uint64(33)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and number of each row. Ids may be null or repeated; a row has the same number at each reading."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))


def sketch(docs: DataFrame, forest: Forest, words: int) -> DataFrame:
    """Per numbered row: id, row, node, bytes of text, and the node's label in each tree (none without words)."""

    def run(batch: pa.RecordBatch):
        nodes, sizes, keys, rests = [], [], [], []
        for i, text in enumerate(texts(batch.column(1))):
            own = shingle_set(text, words)
            nodes.append(node_of(batch.column(2)[i].as_py() if text is None else None, text, own))
            sizes.append(len(text or ""))
            key, rest = forest.labels(own) if len(own) else (own, own)
            keys.append(as_long(key))
            rests.append(rest.astype(np.int32))
        columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(rests, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "row", "node", "bytes", "keys", "rests"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_rows(docs, run, f"id {kind}, row bigint, node binary, bytes bigint, keys array<bigint>, rests array<int>")


def shorten(nodes: DataFrame, spare: int) -> DataFrame:
    """Nodes with the label by which they are matched in each tree: of the shortest prefix, but of the whole label where
    all nodes that share that prefix have it among the `spare` branches that are their largest."""
    entries = nodes.select("row", F.posexplode("keys").alias("tree", "key"))  # the row of a node is its own
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    largest = Window.partitionBy("row").orderBy(F.desc("n"), "tree")
    told = entries.join(sizes, "key").withColumn("deep", F.row_number().over(largest) <= spare)
    whole = told.groupBy("key").agg(F.bool_and("deep").alias("all")).filter("all").select("key")
    deep = told.join(whole, "key").groupBy("row").agg(F.collect_set("tree").alias("deep"))
    matched = lambda k, i: F.when(F.coalesce(F.array_contains("deep", i), F.lit(False)), F.xxhash64(k, F.get("rests", i))).otherwise(k)
    return nodes.join(deep, "row", "left").withColumn("keys", F.transform("keys", matched)).drop("deep", "rests")


def block_rows(nodes: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """A row for each node and pair of blocks in which it is compared, for every branch of two nodes or more."""
    entries = nodes.filter(F.size("keys") > 0).select("node", "bytes", F.posexplode("keys").alias("tree", "key"))
    member = F.xxhash64("node")
    branches = (
        entries.groupBy("tree", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("bytes").alias("held"),
            F.bit_xor(member).alias("members"),
            F.min("node").alias("least"),
        )
        .filter("n > 1")
    )
    kept = branches.groupBy("n", "members", "least", "held").agg(F.min(F.struct("tree", "key")).alias("at"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") / block_bytes)).cast("int")
    kept = kept.select(F.col("at.tree").alias("tree"), F.col("at.key").alias("key"), parts.alias("parts"))
    met = entries.select("node", "tree", "key").join(kept, ["tree", "key"])
    return met.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))


def compare_blocks(rows: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """rows: sorted by (key, low, high) in each partition. Gives node, root of its local component, links."""
    ship(rows.sparkSession)
    num, den = threshold.numerator, threshold.denominator
    out = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])

    def compare(group: list[tuple], across: bool) -> pa.RecordBatch | None:
        # (node, copies, own, tree, keys, text)
        seen: dict[bytes, tuple] = {}
        for g in group:
            if g[0] not in seen:
                own = shingle_set(g[5], words)
                if node_of(None, g[5], own) != g[0]:
                    raise RuntimeError("a row's text isn't the one that was sketched: the input gave its rows in another order")
                seen[g[0]] = (*g[:5], own)
        if len(seen) < 2:
            return None
        group = sorted(seen.values(), key=lambda g: g[0])
        m, tree = len(group), group[0][3]
        sets = [g[5] for g in group]
        size = np.array([len(s) for s in sets], np.int64)
        keys = np.array([g[4][: tree + 1] for g in group], np.int64).reshape(m, -1)
        block = np.array([g[2] for g in group])
        count = np.array([g[1] for g in group], np.int64)
        both = np.zeros((m, m), np.int64)
        if m <= 4:
            for i in range(m):
                for j in range(i):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            order = np.cumsum(times > 1) - 1
            keep = times[place] > 1
            row, col = np.repeat(np.arange(m), size)[keep], order[place[keep]]
            by = np.argsort(col, kind="stable")
            row, col = row[by], col[by]
            step = 4096
            for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
                a, b = np.searchsorted(col, (c, c + step))
                held = np.zeros((m, step), np.float32)
                held[row[a:b], col[a:b] - c] = 1
                both += np.rint(held @ held.T).astype(np.int64)
        linked = both * (num + den) >= num * (size[:, None] + size[None, :])
        np.fill_diagonal(linked, False)
        if across:
            linked &= block[:, None] != block[None, :]
        for t in range(tree):
            linked &= keys[:, t][:, None] != keys[:, t][None, :]
        links = linked.astype(np.int64) @ count
        root = np.arange(m)
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([group[i][0] for i in hit], pa.binary()),
                pa.array([group[root[i]][0] for i in hit], pa.binary()),
                pa.array(links[hit]),
            ],
            schema=out,
        )

    def run(batches):
        forget()
        at, group = None, []
        for batch in batches:
            cols = [batch.column(k) for k in range(9)]
            for i in range(batch.num_rows):
                here = (cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py())
                if here != at:
                    if len(group) > 1 and (got := compare(group, at[1] != at[2])) is not None:
                        yield got
                    at, group = here, []
                group.append(tuple(cols[k][i].as_py() for k in range(3, 9)))
        if len(group) > 1 and (got := compare(group, at[1] != at[2])) is not None:
            yield got

    fed = rows.select("key", "low", "high", "node", "copies", "own", "tree", "keys", "text")
    return fed.mapInArrow(run, "node binary, root binary, links bigint")


def connected(edges: DataFrame) -> DataFrame:
    """Least node of each node's component, by rounds of least neighbour and label of label. edges: node, root.

    Labels only fall, and a round in which none does is the last. Rounds grow with the logarithm of a path, mostly."""
    edges = edges.filter("node <> root").distinct()
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))).checkpoint()
    labels = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("label")).checkpoint()
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("root"), F.col("label").alias("theirs")), "root")
            .groupBy("node")
            .agg(F.min("theirs").alias("theirs"))
        )
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = met.join(far, "label", "left").select("node", "old", F.least("label", "next").alias("label")).checkpoint()
        moved = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def jaccard_classes(
    docs: DataFrame,
    words: int = WORDS,
    threshold: Fraction = THRESHOLD,
    forest: Forest | None = None,
    block: int = 128,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: the id, class_id, and n_links, the other rows with a similarity of at least the threshold."""
    spark: SparkSession = docs.sparkSession
    ensure_checkpoint_dir(spark)
    forest = forest or Forest(similarity=float(threshold))
    read = numbered(docs, id_col, text_col)
    rows = sketch(read, forest, words).checkpoint()
    nodes = rows.groupBy("node").agg(
        F.min("id").alias("rep"),
        F.min("row").alias("row"),
        F.count(F.lit(1)).alias("copies"),
        F.max("bytes").alias("bytes"),
        F.first("keys").alias("keys"),
        F.first("rests").alias("rests"),
    ).checkpoint()
    nodes = shorten(nodes, forest.spare).checkpoint()
    met = block_rows(nodes, block, block_bytes)
    asked = met.join(nodes.select("node", "row", "copies", "keys"), "node").withColumn("keys", F.slice("keys", 1, F.col("tree") + 1))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    fed = (
        asked.join(read.select("row", "text"), "row")
        .select("*", other)
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .repartition(F.col("key"), F.col("low"), F.col("high"))
        .sortWithinPartitions("key", "low", "high")
    )
    found = compare_blocks(fed, words, threshold).checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(found.select("node", "root"))
    known = nodes.select("node", "rep", "copies").join(links, "node", "left").join(labels, "node", "left")
    told = known.filter("copies > 1 or links is not null").select(
        "node", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label")
    )
    told = told.checkpoint()
    least = told.groupBy("label").agg(F.min("rep").alias("class_id"))
    told = told.join(least, "label").select("node", "class_id", "n_links").checkpoint()
    return rows.join(told, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each class of rows one stays, which has the least id.

    Rows are judged, not ids: of rows with one id each has the fate of its own text. A null id comes last, and rows of
    equal id and text, or of null ids, are told apart by their place. Null texts all stay. docs are read twice and must
    give their rows in the same order, as written tables do."""
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    own = spare(docs, "__row")
    rows = docs.withColumn(own, row)
    others = jaccard_classes(rows, id_col=own).filter(F.col("class_id") != F.col(own)).select(own).checkpoint()
    return rows.join(others, own, "left_anti").select(*docs.columns)
