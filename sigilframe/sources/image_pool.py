"""A pool of image files as a data source of Spark: read in batch and as a stream, written with two phases.

A pool is a folder of parts, each a folder of PNG files that one task wrote, with the list of them. Tasks write into a
staging folder of their own attempt. The driver commits by moving the parts of the attempts that succeeded, a rename
each, and then writing one file that names them; readers see parts that such a file names and nothing else. What other
attempts have left is removed, at the commit or at the abort.

The reader's partitions are runs of files of a listing, about `files` each; a stream's offsets are commits. Files are
read and decoded by tasks; a file that can't be decoded is an error that names it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..session import ship

FORMAT = "imagepool"
SCHEMA = "path string, id string, height int, width int, nChannels int, data binary"
#: The first bytes of a PNG file, and channels by colour type.
MAGIC, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """Pixels (height, width, channels; blue, green, red) of a file of eight bits a channel without interlacing."""
    if content[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, head, packed = 8, b"", []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut off")
        head, packed = (body if kind == b"IHDR" else head), [*packed, body] if kind == b"IDAT" else packed
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("of a kind that isn't read here")
    n = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.uint8)  # a line and a column of zeros before the first
    for y in range(h):
        _unfilter(int(rows[y, 0]), rows[y, 1:].reshape(w, n), out, y + 1)
    pixels = out[1:, 1:]
    return pixels if n == 1 else np.ascontiguousarray(pixels[:, :, [2, 1, 0, *range(3, n)]])


def _unfilter(kind: int, line: np.ndarray, out: np.ndarray, y: int) -> None:
    """Adds to each value what its filter predicts from the left, above, both, or the nearest of three."""
    if kind in (0, 2):
        out[y, 1:] = line + (out[y - 1, 1:] if kind else 0)
        return
    for x in range(1, len(line) + 1):
        left, up, corner = (v.astype(int) for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]))
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y, x] = (line[x - 1] + guess) & 255


class Pool:
    """A pool's folder in whatever file system its address names."""

    def __init__(self, path: str):
        local = re.sub("^file:/*", "/", path)
        self.files, self.root = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)

    def at(self, *names: str) -> str:
        return "/".join((self.root.rstrip("/"), *names))

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found)

    def read(self, *names: str) -> bytes:
        with self.files.open_input_stream(self.at(*names)) as f:
            return f.read()

    def write(self, data: bytes, *names: str) -> None:
        with self.files.open_output_stream(self.at(*names)) as f:
            f.write(data)

    def drop(self, *names: str) -> None:
        if self.files.get_file_info(self.at(*names)).type == fs.FileType.Directory:
            self.files.delete_dir(self.at(*names))

    def commits(self) -> list[str]:
        return [x for x in self.names("_commits") if x.endswith(".json")]

    def parts(self, first: int = 0, last: int | None = None) -> list[str]:
        """Parts that the commits name, in order; one that overwrites makes those before it void."""
        out: list[str] = []
        for name in self.commits()[first:last]:
            told = json.loads(self.read("_commits", name))
            out = told["parts"] if told["overwrite"] else out + told["parts"]
        return out


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...] = ()


def files_of(pool: Pool, parts: list[str], most: int) -> list[Files]:
    paths = [f"{part}/{name}" for part in parts for name in pool.read(part, "list.txt").decode().splitlines()]
    return [Files(tuple(paths[i : i + most])) for i in range(0, len(paths), most)] or [Files(())]


def decoded(pool: Pool, paths: tuple[str, ...], batch: int = 64) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), *[pa.int32()] * 3, pa.binary()]
    names = ["path", "id", "height", "width", "nChannels", "data"]
    for i in range(0, len(paths), batch):
        rows = []
        for path in paths[i : i + batch]:
            try:
                pixels = decode_png(pool.read(path))
            except (ValueError, KeyError, struct.error, zlib.error) as e:
                raise ValueError(f"cannot decode {pool.at(path)}: {e}") from e
            rows.append((pool.at(path), path.rsplit("/", 1)[-1].removesuffix(".png"), *pixels.shape, pixels.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class PoolReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        pool = Pool(self.path)
        return files_of(pool, pool.parts(), self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from decoded(Pool(self.path), partition.paths)


class PoolStream(DataSourceStreamReader):
    """Offsets count commits, so a batch is made of whole commits, and the same ones when it is run again."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Pool(self.path).commits())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pool = Pool(self.path)
        return files_of(pool, pool.parts(start["commits"], end["commits"]), self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from decoded(Pool(self.path), partition.paths)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Part(WriterCommitMessage):
    attempt: str
    files: int


class PoolWriter(DataSourceArrowWriter):
    """Rows of id and content, a PNG file each. Ids name files, so they must be plain names.

    The driver makes the job's staging folder and drops it at the end; a task that still runs then, as the job has failed
    elsewhere, can't stage any more.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        pool = Pool(path)
        pool.files.create_dir(pool.at("_staging", self.job), recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        pool, attempt, names = Pool(self.path), uuid.uuid4().hex, []
        place = f"_staging/{self.job}/{attempt}"
        try:
            pool.files.create_dir(pool.at(place), recursive=False)
            for batch in iterator:
                for key, content in zip(batch.column("id").to_pylist(), batch.column("content"), strict=True):
                    if key is None or not re.fullmatch(r"[\w.-]+", key) or not content.is_valid:
                        raise ValueError(f"{key!r} names no file, or has no content")
                    names.append(f"{key}.png")
                    pool.write(content.as_py(), place, names[-1])
            pool.write("".join(f"{n}\n" for n in names).encode(), place, "list.txt")
        except BaseException:
            pool.drop(place)
            raise
        return Part(attempt, len(names))

    def commit(self, messages: list[Part | None]) -> None:
        pool = Pool(self.path)
        parts = [f"part-{m.attempt}" for m in messages if m is not None and m.files]
        before = pool.parts() if self.overwrite else []
        for part in parts:
            pool.files.move(pool.at("_staging", self.job, part.removeprefix("part-")), pool.at(part))
        pool.files.create_dir(pool.at("_commits"), recursive=True)
        told = json.dumps({"overwrite": self.overwrite, "parts": parts}).encode()
        name = f"{len(pool.commits()):08d}.json"
        pool.write(told, "_commits", f"{name}.new")
        pool.files.move(pool.at("_commits", f"{name}.new"), pool.at("_commits", name))
        for part in before:
            pool.drop(part)
        self._clean(pool)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(Pool(self.path))

    def _clean(self, pool: Pool) -> None:
        """What attempts of this job have staged and no commit has moved."""
        pool.drop("_staging", self.job)


class ImagePool(DataSource):
    """Options: path, and files, how many of them a partition has."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _most(self) -> int:
        return int(self.options.get("files", 1024))

    def reader(self, schema) -> PoolReader:
        return PoolReader(self.options["path"], self._most())

    def streamReader(self, schema) -> PoolStream:
        return PoolStream(self.options["path"], self._most())

    def writer(self, schema, overwrite: bool) -> PoolWriter:
        return PoolWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ImagePool)


def write_pool(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows of id and content into a pool, a file each."""
    register(rows.sparkSession)
    rows.select("id", "content").write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def read_pool(spark: SparkSession, path: str, files: int = 1024) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("files", files).load(path)


def stream_pool(spark: SparkSession, path: str, files: int = 1024) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("files", files).load(path)
