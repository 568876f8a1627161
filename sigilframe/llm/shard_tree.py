"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are leaves of a tree of regions and racks, and a node weighs what its leaves weigh. A document descends: at each
level every child draws -ln(u) / weight, with u from a hash of the document's id and the child, and the least draw is
taken, so a child is chosen in proportion to its weight. For 40 shards that is 5 draws for the region, 2 for the rack
and 4 for the shard. A draw depends on its own node only. So a changed weight moves documents only into or out of the
nodes whose weight changed: between regions only those that enter or leave the shard's region, and within that region
only those that enter or leave its rack.

A tree is built for `base` shards. Shards that are added later are regions of their own: no other node's weight
changes, and each takes documents only into itself, whatever the count.

A slot is a row's place in its shard. A shard holds a fixed share of all rows, so no task may number a whole one:
rows are numbered inside (shard, bucket) and shifted by the counts of the buckets before. A row's bucket is drawn from
its place in the written table of assignments, so that equal rows don't share one.

Defined results: a null text counts as empty (size 16, crc 0); a null id is drawn like any other value and its
rows share a shard; repeated rows get the same shard and different slots; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


Tree = list[list[list[int]]]


@dataclass(frozen=True)
class Topology:
    """Shard s stands in region s div per_region and, there, in rack (s mod per_region) div per_rack."""

    per_region: int = 8
    per_rack: int = 4

    def tree(self, shards: int, base: int | None = None) -> Tree:
        """Regions of racks of shards. base: shards that the tree was built for; those after stand alone."""
        base = shards if base is None else min(base, shards)
        regions: dict[int, dict[int, list[int]]] = {}
        for s in range(base):
            rack = s % self.per_region // self.per_rack
            regions.setdefault(s // self.per_region, {}).setdefault(rack, []).append(s)
        return [list(racks.values()) for racks in regions.values()] + [[[s]] for s in range(base, shards)]


def draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight, with u in (0, 1) from 52 bits of the hash of key and node."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def choose(key: Column, names: list[str], weights: list[float]) -> Column:
    """Place of the least draw; ties go to the first, and children without weight draw only if none has any."""
    able = [i for i, w in enumerate(weights) if w > 0] or list(range(len(weights)))
    if len(able) == 1:
        return F.lit(able[0])
    draws = [F.struct(draw(key, names[i], weights[i] or 1.0).alias("draw"), F.lit(i).alias("place")) for i in able]
    return F.array_min(F.array(*draws))["place"]


def descend(key: Column, tree: Tree, weights: dict[int, float]) -> Column:
    """Shard of the least region's least rack's least leaf. A node is named after its first leaf and its level."""
    leaf = lambda s: weights.get(s, 1.0)
    rack = lambda leaves: sum(map(leaf, leaves))
    region = lambda racks: sum(map(rack, racks))

    def in_rack(leaves: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, leaves)), choose(key, [f"shard {s}" for s in leaves], list(map(leaf, leaves))))

    def branch(place: Column, ways: list[Column]) -> Column:
        """Only the chosen child's draws are made."""
        out = ways[-1]
        for i in range(len(ways) - 2, -1, -1):
            out = F.when(place == i, ways[i]).otherwise(out)
        return out

    def in_region(racks: list[list[int]]) -> Column:
        place = choose(key, [f"rack {leaves[0]}" for leaves in racks], list(map(rack, racks)))
        return let(place, lambda at: branch(at, list(map(in_rack, racks))))

    place = choose(key, [f"region {racks[0][0]}" for racks in tree], list(map(region, tree)))
    return let(place, lambda at: branch(at, list(map(in_region, tree))))


def let(value: Column, body) -> Column:
    """Binds a value inside a lambda, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def assign_shards(
    df: DataFrame,
    shards: int,
    weights: dict[int, float] | None = None,
    topology: Topology = Topology(),
    base: int | None = None,
    id_col: str = "doc_id",
    out: str = "shard",
) -> DataFrame:
    """Adds the shard of each row. weights: of shards whose weight isn't 1. base: shards that the tree was built for."""
    return df.withColumn(out, descend(F.col(id_col), topology.tree(shards, base), weights or {}).cast("int"))


def number_slots(df: DataFrame, group: str, buckets: int, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in each group, though no task holds a whole group. df is a written table.

    The counts that are joined have at most `buckets` rows for each group; their size is left to the optimizer.
    """
    place = F.monotonically_increasing_id()
    b = df.withColumn("__place", place).withColumn("__bucket", F.pmod(F.xxhash64("__place"), F.lit(buckets)).cast("int"))
    counts = b.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__bucket").orderBy("__place")
    numbered = b.withColumn("__at", F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(offsets, [group, "__bucket"])
    return joined.withColumn(out, F.col("__at") + F.col("__before")).drop("__bucket", "__place", "__at", "__before")


def shard_documents(df: DataFrame, shards: int = 40, buckets: int = 256) -> DataFrame:
    """The shards of documents under the `key` law: id and shard count decide. grown_shard: with one shard more.

    buckets: parts of a shard that are numbered apart; a part then holds 1 / (shards * buckets) of all rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sized = df.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    both = assign_shards(assign_shards(sized, shards), shards + 1, base=shards, out="grown_shard")
    # written once, so that the texts are read once and both uses see a row at the same place
    slots = number_slots(both.checkpoint(), "shard", buckets)
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
