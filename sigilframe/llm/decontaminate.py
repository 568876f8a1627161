"""Benchmark decontamination as a prefix-filtered set join.

A window is a run of 13 item words, or the whole of a shorter item. Its shingles (runs of 3 words, fewer if the
window is shorter) are ordered by rarity: items that hold them, then length, then hash. As a document must hold all
of a window's shingles, one is a sufficient prefix: the rarest. Documents are read once. Their shingles that pass a
bit filter over the prefixes, of 16 bits for each but 16 MB at most, become candidates, each with its place and the words around it;
candidates join the prefixes by hash, the offset of the prefix in its window bounds place and length, and the words
are compared with the window's. The prefixes are written once. Only candidates, counts and hits are shuffled, and
nothing but the filter is sent to the executors whole, so a benchmark of any size takes the same path.

Defined results: a null text has no words and no hits; an item without words has no window; an item with a null id
hits, but is in no list of ids; repeated rows of documents each get a row, repeated items count once by id; empty
tables give no rows or no hits; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, ensure_checkpoint_dir, fold_words, map_rows, shingle_hashes, spare, texts, word_hashes

#: Words of a window and of a shingle; the largest filter is of 2 ** FILTER_BITS bits.
WINDOW, SHINGLE, FILTER_BITS = 13, 3, 27


def item_shingles(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Per item and place: the shingle's hash and length, the item's words in all, and the words of its window."""

    def run(batch: pa.RecordBatch):
        for i, text in enumerate(texts(batch.column(1))):
            joined = fold_words(text)
            h, starts, ends = word_hashes(joined)
            n = len(h)
            if not n:
                continue
            wide = min(window, n)
            size = min(shingle, wide)
            own = shingle_hashes(h, size)
            windows = [joined[starts[k] : ends[k + wide - 1]].decode("utf-8", "surrogatepass") for k in range(n - wide + 1)]
            windows += [None] * (len(own) - len(windows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[i].as_py()] * len(own), batch.column(0).type),
                    pa.array([batch.column(2)[i].as_py()] * len(own), pa.int64()),
                    pa.array(np.arange(len(own), dtype=np.int32)),
                    pa.array(as_long(own)),
                    pa.array((ends[size - 1 :] - starts[: n - size + 1]).astype(np.int32)),
                    pa.array([size] * len(own), pa.int32()),
                    pa.array([wide] * len(own), pa.int32()),
                    pa.array(windows, pa.string()),
                ],
                ["item_id", "item_row", "place", "token", "bytes", "size", "wide", "words"],
            )

    kind = items.schema[id_col].dataType.simpleString()
    schema = f"item_id {kind}, item_row bigint, place int, token bigint, bytes int, size int, wide int, words string"
    return map_rows(items.select(id_col, text_col, F.monotonically_increasing_id().alias("uid")), run, schema)


def window_prefixes(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Per window: its words, and the hash of its rarest shingle with the offset of that in the window."""
    at = item_shingles(items, window, shingle, id_col, text_col)
    rarity = at.groupBy("token").agg(F.countDistinct("item_id").alias("items"))
    ranked = at.join(rarity, "token").withColumn(
        "rank", F.struct("items", (-F.col("bytes")).alias("short"), "token", "place")
    )
    per_item = Window.partitionBy("item_row").orderBy("place")
    inside = F.min("rank").over(per_item.rowsBetween(0, max(0, window - shingle)))
    best = F.col("best")
    out = ranked.withColumn("best", inside)
    return out.filter(F.col("words").isNotNull()).select(
        "item_id",
        "words",
        "wide",
        "size",
        best["token"].alias("token"),
        (best["place"] - F.col("place")).alias("offset"),
    )


def prefix_filter(prefixes: DataFrame, most: int) -> tuple[np.ndarray, list[int]]:
    """A bit for each token's low bits, in words of 64, 2 ** most bits in all at most; and the sizes of shingle in use."""
    told = prefixes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most as many as a shingle has words
    bits = min(most, max(16, (16 * sum(r["n"] for r in told)).bit_length()))
    low = F.col("token").bitwiseAND((1 << bits) - 1)
    words = (
        prefixes.groupBy(F.shiftrightunsigned(low, 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(token & 63 as int)))").alias("held"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["held"].to_numpy()
    return out.view(np.uint64), sorted(r["size"] for r in told)


def candidates(docs: DataFrame, held: np.ndarray, sizes: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: its words, and the shingles that pass the filter with place and surroundings."""
    low = np.uint64((len(held) << 6) - 1)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch):
        held = sent.value
        n_words, found = [], []
        for text in texts(batch.column(1)):
            joined = fold_words(text)
            h, starts, ends = word_hashes(joined)
            n, own = len(h), []
            for size in sizes:
                if n < size:
                    continue
                tokens = shingle_hashes(h, size)
                slot = tokens & low
                hit = np.flatnonzero(held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                for p, token in zip(hit.tolist(), as_long(tokens)[hit].tolist(), strict=True):
                    a, b = max(0, p - window + 1), min(n, p + window)
                    around = joined[starts[a] : ends[b - 1]].decode("utf-8", "surrogatepass")
                    own.append({"token": token, "size": size, "place": p, "first": a, "around": around})
            n_words.append(n)
            found.append(own)
        kind = pa.list_(
            pa.struct(
                [("token", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("first", pa.int32()), ("around", pa.string())]
            )
        )
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, kind)], ["id", "n_words", "found"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, found array<struct<token:bigint,size:int,place:int,first:int,around:string>>"
    return map_rows(docs.select(id_col, text_col), run, schema)


def benchmark_overlap(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    filter_bits: int = FILTER_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    ensure_checkpoint_dir(docs.sparkSession)
    prefixes = window_prefixes(items, window, shingle, item_col, item_text_col).checkpoint()
    held, sizes = prefix_filter(prefixes, filter_bits)
    base = candidates(docs, held, sizes, window, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # a document without candidates joins by a key of its own, not by null, which would meet in one task
    found = base.select("id", "row", "n_words", F.explode_outer("found").alias("c")).select(
        "id",
        "row",
        "n_words",
        F.coalesce(F.col("c.token"), F.xxhash64("row")).alias("token"),
        F.col("c.size").alias("size"),
        F.col("c.place").alias("place"),
        F.col("c.first").alias("first"),
        F.col("c.around").alias("around"),
    )
    w = prefixes.select(*[F.col(c).alias(f"w_{c}") for c in prefixes.columns])
    start = F.col("place") - F.col("w_offset")
    near = F.array_join(F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("w_wide")), " ")
    same = (
        (F.col("token") == F.col("w_token"))
        & (F.col("size") == F.col("w_size"))
        & (start >= F.col("first"))
        & (start + F.col("w_wide") <= F.col("n_words"))
        & (F.when(start >= F.col("first"), near) == F.col("w_words"))
    )
    hits = found.join(w, same, "left").select(
        "id",
        "row",
        "n_words",
        F.when(F.col("w_token").isNotNull(), F.struct(start.alias("a"), (start + F.col("w_wide")).alias("b"))).alias("span"),
        F.col("w_item_id").cast("string").alias("item"),
    )
    per = hits.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(
        "spans",
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["b"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["to"], s["a"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return per.withColumn("n_hit", union).select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated. Rows are judged, not ids, which may be null or repeated; docs are read
    twice and must give their rows in the same order, as written tables do."""
    own = spare(docs, "__row")
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    found = benchmark_overlap(rows, items, id_col=own).filter("contaminated").select(own)
    return rows.join(found, own, "left_anti").select(*docs.columns)
