"""SentencePiece encoding and decoding that keeps the byte span of every piece.

The text is normalised by the model's compiled character map: at each place the longest prefix that the map
knows is replaced, and for each byte written the place it was read from is kept. Spaces become U+2581, one is
put in front. The normalised text is cut where no piece of the vocabulary can reach across (before a run of
U+2581, and around line feeds), so that each distinct unit is encoded by the library once per worker. The
lengths of the pieces, summed, are places in the normalised text, which the alignment projects to byte spans of
the original.

Defined results: null counts as empty, which gives only the end id; extra columns are not looked at, so clashing
names do no harm; repeated rows give repeated results; an empty table gives an empty result. A text of any length
is encoded whole.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_rows, sha_hex, texts

SPACE = "▁"


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 and the replacements its leaves point to."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | list[int] = []
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            b = data[i]
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


class Normaliser:
    """normalise(text): the normalised bytes, and for each of them and the end the byte of the original."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = (
            spec.add_dummy_prefix,
            spec.remove_extra_whitespaces,
            spec.escape_whitespaces,
        )
        self.space = SPACE.encode() if self.escape else b" "

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(data)
        out, align, at = bytearray(), [], 0

        def put(piece: bytes, where: int) -> None:
            out.extend(piece)
            align.extend([where] * len(piece))

        def step(i: int) -> tuple[int, bytes]:
            hit = self.map.longest(data, i)
            if hit:
                return hit
            b = data[i]
            n = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return n, data[i : i + n]

        if self.squeeze:
            while at < len(data):
                n, piece = step(at)
                if piece != b" ":
                    break
                at += n
        if at >= len(data):
            return b"", np.full(1, len(data))
        if self.prefix:
            put(self.space, at)
        after_space = self.squeeze
        while at < len(data):
            n, piece = step(at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            for b in piece:
                put(self.space if b == 32 else bytes((b,)), at)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                at = align[len(out) - len(self.space)]
                del out[-len(self.space) :], align[-len(self.space) :]
        align.append(at)
        return bytes(out), np.array(align, np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """An empty map replaces nothing: only spaces change, so the alignment is computed for all bytes at once."""
        body = data.replace(b" ", self.space)
        width = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
        align = np.repeat(np.arange(len(data)), width)
        head = self.space if self.prefix else b""
        return head + body, np.concatenate((np.zeros(len(head), np.int64), align, [len(data)]))


class PieceCodec:
    """Encoder and decoder for one model file; `kept` bounds the units remembered by a worker."""

    def __init__(self, model_file: str, kept: int = 200_000, longest: int = 64):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_file, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        self.normaliser = Normaliser(model.normalizer_spec)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.eos = self.whole.eos_id()
        kinds = pb.ModelProto.SentencePiece
        used = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.spelled = model.trainer_spec.byte_fallback
        #: Units are cut before U+2581 and around line feeds; right only if no piece reaches across.
        self.cuts = (
            model.trainer_spec.model_type == model.trainer_spec.BPE
            and self.spelled
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not self.normaliser.squeeze
            and self.normaliser.escape
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in used)
            and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        )
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.width = np.array(
            [
                1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode())
                for p in model.pieces
            ],
            np.int64,
        )
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.precompiled_charsmap = b""
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.units: dict[str, tuple[list[int], bytes]] = {}
        self.kept, self.longest = kept, longest

    def _unit(self, unit: str) -> tuple[list[int], bytes]:
        ids = self.bare.encode(unit, num_threads=1)
        got = ids, " ".join(map(str, ids)).encode()
        if len(unit) <= self.longest:
            if len(self.units) >= self.kept:
                self.units.clear()
            self.units[unit] = got
        return got

    def encode(self, text: str) -> tuple[list[int], bytes, bytes, np.ndarray]:
        """Ids with the end id, the same in decimal, the normalised text, its alignment."""
        normal, align = self.normaliser.normalise(text.encode("utf-8", "surrogatepass"))
        if not self.cuts:
            ids = self.whole.encode(text, add_eos=True, num_threads=1)
            return ids, " ".join(map(str, ids)).encode(), normal, align
        known, ids, said = self.units.get, [], []
        for unit in self.unit.findall(normal.decode("utf-8", "surrogatepass")):
            own, words = known(unit) or self._unit(unit)
            ids += own
            said.append(words)
        ids.append(self.eos)
        said.append(str(self.eos).encode())
        return ids, b" ".join(said), normal, align

    def spans(self, ids: list[int], align: np.ndarray) -> np.ndarray:
        """First byte and end, in the original, of each id. The end id has the empty span at the end.

        An unknown piece has no length of its own, so the model must spell unknown characters in bytes.
        """
        if not self.spelled:
            raise NotImplementedError("spans need a model with byte fallback")
        ends = np.cumsum(self.width[np.array(ids)])
        ends = np.minimum(ends, len(align) - 1)
        starts = np.concatenate(([0], ends[:-1]))
        return np.stack((align[starts], align[ends]), 1)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


def codec(model_file: str) -> PieceCodec:
    return kept(f"pieces {model_file}", lambda: PieceCodec(model_file))


def encode_pieces(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, `ids`, and the byte span of each as `begins` and `ends`."""

    def run(batch: pa.RecordBatch):
        c = codec(model_file)
        for i, text in enumerate(texts(batch.column(1))):
            ids, _, _, align = c.encode(text or "")
            spans = c.spans(ids, align)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, 1),
                    pa.array([ids], pa.list_(pa.int32())),
                    pa.array([spans[:, 0]], pa.list_(pa.int64())),
                    pa.array([spans[:, 1]], pa.list_(pa.int64())),
                ],
                ["id", "ids", "begins", "ends"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = map_rows(
        df.select(id_col, text_col),
        run,
        f"id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>",
        keeps=f"pieces {model_file}",
    )
    return out.withColumnRenamed("id", id_col)


def piece_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text; per row n_tokens, digests of ids and decoded text, and of all spans."""

    def run(batch: pa.RecordBatch):
        c = codec(model_file)
        n, ids_sha, text_sha, spans_crc = [], [], [], []
        for text in texts(batch.column(1)):
            ids, said, _, align = c.encode(text or "")
            n.append(len(ids))
            ids_sha.append(sha_hex(said))
            text_sha.append(sha_hex(c.decode(ids).encode("utf-8", "surrogatepass")))
            spans_crc.append(zlib.crc32(c.spans(ids, align).tobytes()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(ids_sha, pa.string()),
                pa.array(text_sha, pa.string()),
                pa.array(spans_crc, pa.int64()),
            ],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint"
    return map_rows(df.select(id_col, text_col), run, schema, keeps=f"pieces {model_file}").withColumnRenamed("id", id_col)
