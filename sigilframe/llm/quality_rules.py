"""Quality rules with thresholds that adapt to language and source.

Each document has a few rates. The distributions of those that pass the base rule are kept as quantile sketches with
logarithmic bins (a value is known within 4 percent), which are counts and therefore merge by addition: those of a
language's sources make that language's sketch, and all make the corpus's. From its quartiles a language and source
gets an upper fence for every rate, and a lower one for the length of words: `reach` times the distance of the quartiles
beyond them. A measure that most documents of the group don't have has equal quartiles, so the upper fence is at least
the group's quantile TAIL, which bounds the share of a group that the measure may call outliers, and at least PRIOR, a
rate that is nobody's fault. Fences are the outer edges of bins, so what a whole group has alike is inside.

A fence is a rate, and a document of n words (or lines) is expected to have fence * n at most; it is kept if no count is
beyond that by more than `errors` standard errors of such a count, sqrt(fence * n + 1). So a short document isn't
condemned by one or two symbols or lines, and a long one is held to the rate itself. Where language and source have
fewer than `least` documents, the language's fences hold, or else the corpus's.

The sketches are grouped by Spark, so a source with a third of all rows is summed before it is shuffled, and the
fences are joined to the measures.

Defined results: a null text has no words and fails the base rule; a null language or source is a group of its own;
repeated rows are measured like others, and rows with equal counts in a group share a verdict; a count right at its
bound is kept; texts of any length are measured whole, one at a time; extra columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, map_rows, texts
from .text_measures import measure

#: Width of a bin, and the value that the first one starts with.
GAMMA, FIRST = 1.04, 1e-4
#: Measure and, in thousandths, the quantile of its group that its upper fence isn't below: the tail beyond is what it
#: may condemn at most where quartiles are equal. Symbols and long words are marks of whole kinds of junk, so their
#: tails are wide; repeated lines and words are common in good documents too, and only extremes count.
TAIL = {"symbols": 800, "dup_lines": 999, "repeats": 999, "word_length": 800}
#: Documents of a group that don't make a tail by themselves, so that in a small group the one outlier isn't its measure.
ALONE = 1
#: Rates that no upper fence is below, whatever the group: one symbol, repeated line or repeated word in twenty.
PRIOR = {"symbols": 0.05, "dup_lines": 0.05, "repeats": 0.05, "word_length": 0.0}
#: Measures that have a lower fence too.
LOWER = ("word_length",)


def base_measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""

    def run(batch: pa.RecordBatch):
        rows = []
        for text in texts(batch.column(3)):
            m = measure(text)
            lines = text.count("\n") + 1 if text else 0
            rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, lines))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names)

    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    chosen = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in names[3:])
    return map_rows(chosen, run, schema)


#: Measure, its count, and what it is counted in.
SHARES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def size_of(column: str) -> Column:
    return F.greatest(F.col(column), F.lit(1))


def ratios() -> dict[str, Column]:
    return {m: F.col(k) / size_of(n) for m, (k, n) in SHARES.items()}


def bin_of(value: Column) -> Column:
    return F.when(value < FIRST, 0).otherwise((F.floor(F.log(value / FIRST) / math.log(GAMMA)) + 1).cast("int"))


def upper_edge(at: Column) -> Column:
    """No value of a bin is above it."""
    return FIRST * F.pow(F.lit(GAMMA), at.cast("double"))


def lower_edge(at: Column) -> Column:
    return F.when(at == 0, F.lit(0.0)).otherwise(FIRST * F.pow(F.lit(GAMMA), at - 1.0))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them inside repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts of bins by level (0 language and source, 1 language, 2 all) and measure, of what passes the base rule."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(v).alias("bin")) for m, v in ratios().items()])
    each = measured.filter(~base_failed()).select("lang", "source", F.explode(pairs).alias("p"))
    own = each.groupBy("lang", "source", "p.measure", "p.bin").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    merged = lambda level, lang: own.groupBy(lang.alias("lang"), "measure", "bin").agg(F.sum("n").alias("n")).select(
        F.lit(level).alias("level"), "lang", none.alias("source"), "measure", "bin", "n"
    )
    return (
        own.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n")
        .unionByName(merged(1, F.col("lang")))
        .unionByName(merged(2, none))
    )


def fences(sketch: DataFrame, reach: float) -> DataFrame:
    """Upper and lower fences of each level and group, with the documents they stand on."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    counted = sketch.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bin"))})
    level = lambda q, free=0: F.min(F.when(1000 * (F.col("upto") + free) >= q * F.col("total"), F.col("bin")))
    per = lambda held: F.coalesce(*(F.when(F.col("measure") == m, F.lit(x)) for m, x in held.items()))
    at = counted.groupBy("level", "lang", "source", "measure").agg(
        level(F.lit(250)).alias("low"), level(F.lit(750)).alias("high"), level(per(TAIL), ALONE).alias("tail"), F.max("total").alias("documents")
    )
    first, third = lower_edge(F.col("low")), upper_edge(F.col("high"))
    spread = reach * F.when(F.col("high") == F.col("low"), F.lit(0.0)).otherwise(third - first)
    upper, lower = F.greatest(third + spread, upper_edge(F.col("tail")), per(PRIOR)), first - spread
    of = lambda m, v: F.max(F.when(F.col("measure") == m, v))
    return at.groupBy("level", "lang", "source").agg(
        F.max("documents").alias("documents"), *[of(m, upper).alias(m) for m in TAIL], *[of(m, lower).alias(f"least_{m}") for m in LOWER]
    )


def group_fences(sketch: DataFrame, least: int, reach: float) -> DataFrame:
    """One row for each language and source, with the fence of the first level that has documents enough."""
    at = fences(sketch, reach)
    row = F.struct(*TAIL, *[f"least_{m}" for m in LOWER])
    own = at.filter("level = 0").select("lang", "source", "documents", row.alias("own"))
    # the corpus's is one row; taken over the few rows of level 1 it comes along with the language's
    whole = F.max(F.when(F.col("level") == 2, row)).over(Window.partitionBy(F.lit(1)))
    lang = at.filter("level > 0").withColumn("whole", whole).filter("level = 1").select(
        F.col("lang").alias("l"), F.col("documents").alias("n1"), row.alias("by_lang"), "whole"
    )
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")))
    use = (
        F.when(F.col("documents") >= least, F.col("own")).when(F.col("n1") >= least, F.col("by_lang")).otherwise(F.col("whole"))
    )
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), use.alias("fence"))


def within(errors: float) -> Column:
    """No count is farther beyond what the group's fences expect than so many standard errors."""
    out = F.lit(True)
    for m, (k, n) in SHARES.items():
        most = F.col(f"fence.{m}") * size_of(n)
        out = out & (F.col(k) - most <= errors * F.sqrt(most + 1))
        if m in LOWER:
            least = F.greatest(F.lit(0.0), F.col(f"fence.least_{m}") * size_of(n))
            out = out & (least - F.col(k) <= errors * F.sqrt(least + 1))
    return out


def apply_quality_rules(docs: DataFrame, least: int = 30, reach: float = 3.0, errors: float = 3.0) -> DataFrame:
    """Per row: doc_id, n_words, the four counts of the base rule, base_failed, kept."""
    ensure_checkpoint_dir(docs.sparkSession)
    measured = base_measures(docs).checkpoint()
    # written once, so that the join below deals out both sides and may split the rows of a hot source
    limits = group_fences(sketches(measured), least, reach).checkpoint()
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    return measured.join(limits, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(within(errors), F.lit(False))).alias("kept"),
    )
