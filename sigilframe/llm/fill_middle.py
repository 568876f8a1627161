"""Fill-in-middle transformation over succinct boundaries.

A batch's texts lie in one buffer. One bit a byte marks where a unit (a line with its line feed) ends, another where a
code point begins; both are packed, with a directory of popcounts of blocks (`bit_directory`). The popcount between a
text's ends is its number of units n; two ranks drawn from a hash of the id are selected, which gives the byte cuts of
prefix, middle and suffix; and ranks of the cuts among the code points give their lengths. No text is split.

Forms: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle, plain is the text.

Defined results: null counts as empty, and empty texts are plain with n = 0, as are, whatever n is, texts that hold a
mark; a null id is drawn like an empty string; repeated rows give repeated results, and a text with one unit has an
empty middle or is all middle or suffix; prefix_chars and middle_chars are null where the form is plain; texts of any
length are cut whole (batches are worked on in runs of about 8 MB, or one longer text); an empty table gives an empty
result; other columns aren't looked at, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bit_directory import BitDirectory
from .common import flat, map_rows, runs

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_RUN = 8 << 20


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """The first four groups of eight hex digits of the sha256 of `seed:key`."""
    said = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(said[4 * i : 4 * i + 4]) for i in range(4))  # type: ignore[return-value]


def cuts(data: np.ndarray, at: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text between places `at`: its units, the byte cuts after prefix and middle, and the code points of both."""
    ends = data == 10
    full = at[1:] > at[:-1]
    ends[at[1:][full] - 1] = True
    units, points = BitDirectory(ends), BitDirectory((data & 0xC0) != 0x80)
    below = units.rank(at)
    n = np.diff(below)
    ranks = np.sort(drawn % (n + 1)[:, None], 1)
    cut = np.repeat(at[:-1, None], 2, 1)
    moved = ranks > 0
    cut[moved] = units.select((below[:-1, None] + ranks)[moved]) + 1
    chars = points.rank(np.concatenate((at[:-1], cut[:, 0], cut[:, 1]))).reshape(3, -1)
    return n, cut, np.diff(chars, axis=0).T


def fill_in_middle(
    df: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: the id, n, form, prefix_chars, middle_chars, output. rate and spm_rate are percentages."""
    p, s, m = (x.encode() for x in marks)

    def run(batch: pa.RecordBatch):
        data, at = flat(batch.column(1))
        for a, b in runs(at, _RUN):
            ids = batch.column(0).slice(a, b - a)
            drawn = np.array([draws(seed, x) for x in ids.to_pylist()], np.int64)
            mine, begins = data[at[a] : at[b]], at[a : b + 1] - at[a]
            n, cut, chars = cuts(mine, begins, drawn[:, :2])
            form, out = [], []
            for i, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                text = mine[lo:hi].tobytes()
                if not text or drawn[i, 2] % 100 >= rate or p in text or s in text or m in text:
                    form.append("plain")
                    out.append(text)
                    continue
                x, y = (cut[i] - lo).tolist()
                spm = drawn[i, 3] % 100 < spm_rate
                form.append("spm" if spm else "psm")
                head = (s, text[y:], p, text[:x]) if spm else (p, text[:x], s, text[y:])
                out.append(b"".join((*head, m, text[x:y])))
            plain = np.array([x == "plain" for x in form])
            columns = [
                ids,
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(chars[:, 0], pa.int64(), mask=plain),
                pa.array(chars[:, 1], pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(df.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text from output and form: each mark is in an output once, as texts that hold one are plain."""
    cut = F.split(output, "|".join(f"\\Q{x}\\E" for x in marks), -1)
    first, second, middle = (F.get(cut, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def fim_digests(df: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """fill_in_middle, with the sha256 of the output and of the text restored from it in place of the output."""
    done = fill_in_middle(df, id_col=id_col, **settings)
    marks = settings.get("marks", MARKS)
    return done.select(
        id_col,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), marks).cast("binary"), 256).alias("restored_sha256"),
    )
