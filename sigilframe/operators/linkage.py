"""Links between near-identical rows, components of sources, splits, and their verification."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import theta

#: Share of all pairs from which on blocks are compared in place of candidates by bands.
WIDE = 0.01
#: Edges from which on components are found in rounds and not in one task.
MANY_EDGES = 100_000


def difference_bits(values: Column, bits: int) -> Column:
    """Bit i, from the most significant, says that value i + 1 is above value i. At most 63."""
    at = F.sequence(F.lit(1), F.lit(bits))
    bit = lambda i: F.when(F.get(values, i) > F.get(values, i - 1), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def plan_bands(bits: int, threshold: int, probes: int = 64) -> tuple[int, int]:
    """Bands and the radius searched in each, for the fewest expected candidates. By the pigeonhole, of two values at
    most `threshold` bits apart some band differs in threshold div bands bits at most, so no pair is lost."""
    best = None
    for bands in range(1, min(bits, threshold + 1) + 1):
        radius, width = threshold // bands, bits / bands
        tried = sum(comb(-(-bits // bands), r) for r in range(radius + 1))
        cost = bands * tried * 2.0**-width
        if tried <= probes and (best is None or cost < best[0]):
            best = cost, bands, radius
    return best[1:] if best else (min(bits, threshold + 1), 0)


def candidate_share(bits: int, threshold: int) -> float:
    """Share of all pairs that bands are expected to make candidates of random hashes."""
    bands, radius = plan_bands(bits, threshold)
    return bands * sum(comb(-(-bits // bands), r) for r in range(radius + 1)) * 2.0 ** -(bits / bands)


def near_hashes(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """Distinct hashes hash_a <= hash_b, each with itself too, that differ in `threshold` bits at most, and distance.

    Rows of one hash are one candidate, however many. Where bands tell candidates apart, they are found by them; at a
    wider radius blocks of hashes are compared. Both lose no pair.
    """
    rows = rows.select("hash").distinct()
    other = theta.near(rows, threshold) if candidate_share(bits, threshold) > WIDE else banded(rows, threshold, bits)
    return other.unionByName(rows.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).alias("distance")))


def banded(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """hash_a < hash_b and distance by bands: each hash is cut into some; a join on band and value finds candidates, one
    side with every value inside the radius."""
    bands, radius = plan_bands(bits, threshold)
    edges = [bits * i // bands for i in range(bands + 1)]
    own, near = [], []  # band, first bit, mask of its width, bits that are turned over
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        own.append((i, lo, (1 << (hi - lo)) - 1, 0))
        for r in range(radius + 1):
            near += [(i, lo, (1 << (hi - lo)) - 1, sum(1 << p for p in places)) for places in combinations(range(hi - lo), r)]

    def values(bands: list[tuple[int, int, int, int]]) -> Column:
        """One literal, folded by the optimizer, so that the plan stays small however many values are tried."""
        rows = F.from_json(F.lit(json.dumps([dict(zip("ilwm", b, strict=True)) for b in bands])), "array<struct<i:int,l:int,w:bigint,m:bigint>>")
        value = lambda b: F.call_function("shiftrightunsigned", F.col("hash"), b["l"]).bitwiseAND(b["w"]).bitwiseXOR(b["m"])
        return F.inline(F.transform(rows, lambda b: F.struct(b["i"].alias("band"), value(b).alias("value"))))

    left = rows.select(F.col("hash").alias("hash_a"), values(near))
    right = rows.select(F.col("hash").alias("hash_b"), values(own))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))).cast("int")
    met = left.join(right, ["band", "value"]).filter((F.col("hash_a") < F.col("hash_b")) & (distance <= threshold))
    return met.select("hash_a", "hash_b", distance.alias("distance")).distinct()


def expand(near: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of both hashes of each pair: columns of the rows with _a and _b, the pair's own, each two rows once."""
    side = lambda x: rows.select(F.col("hash").alias(f"hash_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    both = near.join(side("a"), "hash_a").join(side("b"), "hash_b")
    return both.filter((F.col("hash_a") < F.col("hash_b")) | (F.col(f"{columns[0]}_a") < F.col(f"{columns[0]}_b")))


def hamming_pairs(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """Pairs a < b of rows (id, hash, tag) whose hashes differ in `threshold` bits at most: a, b, tag_a, tag_b, distance.

    All pairs are listed, so n rows of a hash give n * (n - 1) / 2; the counts below don't need them.
    """
    found = expand(near_hashes(rows, threshold, bits), rows, ["id", "tag"])
    turned = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return found.select(
        pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), pick("tag_a", "tag_b").alias("tag_a"), pick("tag_b", "tag_a").alias("tag_b"), "distance"
    )


def hash_groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hash", "tag").agg(F.count(F.lit(1)).alias("n"))


def tag_pairs(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """The same by groups of rows with one hash and tag, between different tags: hash, tag and n of both."""
    return expand(near_hashes(rows, threshold, bits), hash_groups(rows), ["tag", "n"]).filter("tag_a <> tag_b")


def tag_distances(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """Pairs of rows of two different tags by distance: tag_a < tag_b, distance, n. One search serves every radius up to
    the threshold, and of wide ones only sums are shuffled."""
    if candidate_share(bits, threshold) > WIDE:
        found = theta.tag_distances(hash_groups(rows), threshold)
    else:
        least, most = F.least("tag_a", "tag_b"), F.greatest("tag_a", "tag_b")
        found = tag_pairs(rows, threshold, bits).select(least.alias("tag_a"), most.alias("tag_b"), "distance", (F.col("n_a") * F.col("n_b")).alias("n"))
    return found.groupBy("tag_a", "tag_b", "distance").agg(F.sum("n").alias("n"))


def links_between(rows: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """Links between sources with each group involved: source_a < source_b, hash, tag, n."""
    if candidate_share(bits, threshold) <= WIDE:
        return source_links(tag_pairs(rows, threshold, bits))
    near = theta.involved(hash_groups(rows), threshold)
    ends = F.least("tag", "other").alias("source_a"), F.greatest("tag", "other").alias("source_b")
    return near.select(*ends, "hash", "tag", "n").distinct()


def source_links(pairs: DataFrame) -> DataFrame:
    """Links between sources, from pairs of groups: source_a < source_b and each group involved."""
    side = lambda x: F.struct(F.col(f"hash_{x}").alias("hash"), F.col(f"tag_{x}").alias("tag"), F.col(f"n_{x}").alias("n"))
    ordered = pairs.select(
        F.least("tag_a", "tag_b").alias("source_a"), F.greatest("tag_a", "tag_b").alias("source_b"), F.explode(F.array(side("a"), side("b"))).alias("g")
    )
    return ordered.select("source_a", "source_b", "g.*").distinct()


def link_summary(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Per link: rows involved on each side and in all, and their share of their source in percent."""
    sized = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("size"))
    counted = links.groupBy("source_a", "source_b").agg(
        F.sum("n").alias("involved"),
        F.sum(F.when(F.col("tag") == F.col("source_a"), F.col("n"))).alias("involved_a"),
        F.sum(F.when(F.col("tag") == F.col("source_b"), F.col("n"))).alias("involved_b"),
    )
    a = sized.select(F.col("tag").alias("source_a"), F.col("size").alias("size_a"))
    b = sized.select(F.col("tag").alias("source_b"), F.col("size").alias("size_b"))
    return (
        counted.join(a, "source_a")
        .join(b, "source_b")
        .select(
            "source_a",
            "source_b",
            "involved",
            "involved_a",
            "involved_b",
            (100.0 * F.col("involved_a") / F.col("size_a")).alias("pct_a"),
            (100.0 * F.col("involved_b") / F.col("size_b")).alias("pct_b"),
        )
    )


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(source), edges(source_a, source_b) -> source, group_id, the least source of its component.

    Up to MANY_EDGES edges are counted first and joined in one task. More take rounds: each takes the least label among
    neighbours, then the label of that label; the lineage is cut by a checkpoint. Labels only fall, and a round in which
    none does is the last.
    """
    ensure_checkpoint_dir(vertices.sparkSession)
    both = edges.select(F.col("source_a").alias("source"), F.col("source_b").alias("other"))
    few = both.distinct().checkpoint()
    if few.count() <= MANY_EDGES:
        found = joined_up(few)
        return vertices.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("group_id", "source").alias("group_id"))
    both = few.unionByName(few.select(F.col("other").alias("source"), F.col("source").alias("other"))).distinct().checkpoint()
    labels = vertices.select("source", F.col("source").alias("group_id")).distinct().checkpoint()
    while True:
        theirs = labels.select(F.col("source").alias("other"), F.col("group_id").alias("theirs"))
        least = both.join(theirs, "other").groupBy("source").agg(F.min("theirs").alias("theirs"))
        met = labels.join(least, "source", "left").select("source", F.col("group_id").alias("old"), F.least("group_id", "theirs").alias("group_id"))
        far = labels.select(F.col("source").alias("group_id"), F.col("group_id").alias("next"))
        new = met.join(far, "group_id", "left").select("source", "old", F.least("group_id", "next").alias("group_id")).checkpoint()
        changed = new.filter("old <> group_id").limit(1).count()
        labels = new.select("source", "group_id")
        if not changed:
            return labels


def joined_up(edges: DataFrame) -> DataFrame:
    """source, group_id of a bounded number of edges (source, other), in one task."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        column = None

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            column = batch.column(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), column), pa.array([root(x) for x in parent], column)], ["source", "group_id"])

    return edges.coalesce(1).mapInArrow(run, f"source {kind}, group_id {kind}")


def group_sizes(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Per group: its sources and rows."""
    sized = rows.groupBy(F.col("tag").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(sized, "source", "left").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum(F.coalesce("n", F.lit(0))).alias("n_rows")
    )


def assign_splits(groups: DataFrame, val: list[str], test: list[str]) -> DataFrame:
    """source, group_id, split. Naming any member holds out its whole group; an unknown name, or a group named for
    both, is an error."""
    known = groups.filter(F.col("source").isin(val + test)).select("source").distinct().count()
    if known != len(set(val) | set(test)):
        raise ValueError("a held-out source is not in any group")
    flag = lambda names: F.max(F.col("source").isin(names) if names else F.lit(False))
    held = groups.groupBy("group_id").agg(flag(val).alias("val"), flag(test).alias("test"))
    both = F.raise_error(F.concat(F.lit("a group is held out for val and test: "), F.col("group_id").cast("string"))).cast("string")
    split = F.when(F.col("val") & F.col("test"), both).when(F.col("val"), "val").when(F.col("test"), "test").otherwise("train")
    return groups.join(held.select("group_id", split.alias("split")), "group_id").select("source", "group_id", "split")


def split_shares(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows of each split and their share in percent."""
    counted = rows.join(assignment.select(F.col("source").alias("tag"), "split"), "tag").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("split", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def leaking_pairs(rows: DataFrame, assignment: DataFrame, threshold: int, bits: int = 63) -> DataFrame:
    """Near pairs whose rows are in different splits, found from the hashes and not from the links."""
    split = assignment.select(F.col("source").alias("tag"), "split")
    tagged = rows.join(split, "tag").select("id", "hash", F.struct("split", "tag").alias("tag"))
    return hamming_pairs(tagged, threshold, bits).filter("tag_a.split <> tag_b.split")


def leak_counts(rows: DataFrame, assignment: DataFrame, threshold: int, bits: int = 63, distances: DataFrame | None = None) -> DataFrame:
    """Leaking pairs by their sources, counted without listing them: source_a < source_b, n. distances: those of
    tag_distances at this radius or a wider one, if they are there."""
    found = tag_distances(rows, threshold, bits) if distances is None else distances.filter(F.col("distance") <= threshold)
    pairs = found.groupBy(F.col("tag_a").alias("source_a"), F.col("tag_b").alias("source_b")).agg(F.sum("n").alias("n"))
    for x in ("a", "b"):
        pairs = pairs.join(assignment.select(F.col("source").alias(f"source_{x}"), F.col("split").alias(f"split_{x}")), f"source_{x}")
    return pairs.filter("split_a <> split_b").select("source_a", "source_b", "n")


def offender_report(counts: DataFrame, most: int = 10) -> DataFrame:
    """The source pairs with most leaking pairs."""
    return counts.orderBy(F.desc("n"), "source_a", "source_b").limit(most)


def check_no_leakage(pairs: DataFrame, allow: bool = False) -> int:
    """Leaking pairs; any is an error unless allowed."""
    n = pairs.count()
    if n and not allow:
        raise ValueError(f"{n} near-identical pairs lie in different splits")
    return n


def random_order(id_col: Column, seed: int = 0) -> Column:
    """A fixed order that looks random."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def least_prefixes(keys: DataFrame, ranks: list[int], key: str = "key", digits: int = 4) -> list[str | None]:
    """For each rank r, a prefix p such that the rows whose key begins with p or less are the r least. No sort.

    Hexadecimal keys are counted by their first digits; what remains of a rank falls into one value, whose rows alone
    are counted by the next digits, until a rank ends with a value. Counts of 16 ** digits values for each rank are all
    that the driver sees. Rows of equal keys are on one side: of the rank's own key all are in. None where r is 0.
    """
    found: list[str | None] = [None] * len(ranks)
    open_ = {i: ("", r) for i, r in enumerate(ranks) if r > 0}
    depth = 0
    while open_:
        depth += digits
        heads = sorted({head for head, _ in open_.values()})
        rows = keys if depth == digits else keys.filter(F.substring(key, 1, depth - digits).isin(heads))
        told = rows.groupBy(F.substring(key, 1, depth).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(key)).alias("long")).collect()
        for i, (head, left) in list(open_.items()):
            del open_[i]
            for value, n, long in sorted(x for x in told if x["value"].startswith(head)):
                if left <= n:
                    break
                left -= n
            else:
                found[i] = "g"  # beyond all digits: there are no more rows than the rank
                continue
            if left == n or long <= depth:
                found[i] = value
            else:
                open_[i] = (value, left)
    return found


def up_to(key: Column, prefix: str | None) -> Column:
    """The rows that a prefix of least_prefixes stands for."""
    return F.lit(False) if prefix is None else F.substring(key, 1, len(prefix)) <= prefix


def listing_gaps(listed: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Listed paths that lack their image or label; listed has path and label_path."""
    no_image = listed.join(images.select("path"), "path", "left_anti").select("path", F.lit("image").alias("missing"))
    no_label = listed.join(labels.select(F.col("path").alias("label_path")), "label_path", "left_anti")
    return no_image.unionByName(no_label.select("path", F.lit("label").alias("missing")))
