"""Tables of patterns, from CSV lines or YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import Pattern, unreachable


def parse_pattern_lines(lines: DataFrame, vocab: tuple[str, ...]) -> DataFrame:
    """From place and line: place, name, element, signs. Cells are trimmed, signs in lower case, blanks skipped.

    The first line may be a header and start with a byte order mark. A pattern without signs, or with a sign outside
    the vocabulary, is an error. A cell in double quotes may hold commas, and a quote twice for one.
    """
    clean = F.concat(F.regexp_replace("line", "^\\uFEFF", ""), F.lit(","))
    raw = F.regexp_extract_all(clean, F.lit('("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    plain = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.transform(raw, lambda c: F.trim(plain(c)))
    rows = lines.select("place", cells.alias("c")).filter(F.exists("c", lambda x: x != ""))
    first = rows.agg(F.min("place")).scalar()  # not a window, which would bring all lines into one task
    header = (F.col("place") == first) & (F.col("c")[0] == "element") & (F.get("c", F.lit(1)) == "jutsu")
    rows = rows.filter(~F.coalesce(header, F.lit(False)))
    signs = F.transform(F.filter(F.slice("c", 3, 1 << 20), lambda x: x != ""), F.lower)
    named = rows.select("place", F.get("c", F.lit(1)).alias("name"), F.col("c")[0].alias("element"), signs.alias("signs"))
    return validate_patterns(named, vocab)


def validate_patterns(rows: DataFrame, vocab: tuple[str, ...]) -> DataFrame:
    fail = lambda text: F.raise_error(text).cast("array<string>")
    odd = F.array_sort(F.array_except("signs", F.array(*map(F.lit, vocab))))
    checked = (
        F.when(F.size("signs") == 0, fail(F.concat(F.lit("a pattern has no signs: "), F.coalesce("name", F.lit("")))))
        .when(F.size(odd) > 0, fail(F.concat(F.lit("a pattern has unknown signs: "), F.coalesce("name", F.lit("")), F.lit(" "), F.array_join(odd, ","))))
        .otherwise(F.col("signs"))
    )
    return rows.withColumn("signs", checked)


def load_patterns(spark: SparkSession, path: str, vocab: tuple[str, ...], warn: bool = True) -> list[Pattern]:
    """The patterns of a .csv, or of a YAML file with a list `jutsu` of name, english and signs. Order is the file's.

    Patterns that can never match are printed. An empty table is an error.
    """
    if path.lower().endswith(".csv"):
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line"))
        rows = parse_pattern_lines(whole, vocab)
    else:
        import yaml

        text = spark.read.text(path, wholetext=True).first()["value"]
        entries = (yaml.safe_load(text) or {}).get("jutsu") or []
        given = [
            (i, str(e.get("name", "?")), str(e.get("english", "")), [str(s).strip().lower() for s in e.get("signs", [])])
            for i, e in enumerate(entries)
        ]
        rows = validate_patterns(spark.createDataFrame(given, "place int, name string, element string, signs array<string>"), vocab)
    rows = rows.orderBy("place")
    found = [Pattern(r["name"], tuple(r["signs"]), r["element"] or "") for r in rows.collect()]
    if not found:
        raise ValueError(f"{path} defines no pattern")
    if warn:
        known = spark.createDataFrame([(i, p.name, list(p.signs)) for i, p in enumerate(found)], "place int, name string, signs array<string>")
        for r in unreachable(known).collect():
            print(f"warning: {r['name']!r} can never match, as {r['blocked_by']!r} ends at its sign {r['at']}")
    return found
