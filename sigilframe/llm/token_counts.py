"""Token counts of a unigram model by dynamic programming on a trie of distinct pre-tokens.

A text's spaces become U+2581, one is put in front, and it is cut into pre-tokens, each a word with the U+2581 before
it. Distinct pre-tokens are inserted in a trie. A node stands for a prefix; when it is made, the best forward score of
that prefix (the greatest sum of piece scores over its segmentations) is found from the nodes above it, once for all
pre-tokens that share it. The count at a pre-token's last node is kept, and a text's count is the sum over its
pre-tokens. Each worker grows one trie over all that it reads and starts anew when it holds too many nodes, so memory
is bounded, nothing is shuffled, and a lost executor loses only what it can count again.

Pieces come from a vocabulary ordered by frequency: the score of rank r is -ln(r + 2), in millionths, by Zipf's law.
Of segmentations with the best score the one of fewest tokens counts. A character that is no piece scores less than
any, and counts one token for each of its bytes.

Defined results: null and empty texts have no tokens; repeated rows get equal counts; an empty table gives an empty
result; extra columns are not looked at. Pre-tokens of any length are counted whole; very long ones stay off the trie.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, texts

SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}?[^{SPACE}\n]+|{SPACE}|\n")


def pretokens(text: str | None) -> list[str]:
    return PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def piece_scores(model_file: str) -> dict[str, int]:
    """Scores of the model's ordinary pieces that can stand in a pre-token, by their rank in its order."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(model_file, "rb") as f:
        pieces = pb.ModelProto.FromString(f.read()).pieces
    normal = [p.piece for p in pieces if p.type == p.NORMAL and SPACE not in p.piece[1:]]
    return {piece: -round(1e6 * math.log(rank + 2)) for rank, piece in enumerate(normal)}


#: A forward score and the tokens it takes are one number, score * TOKEN - tokens, so that greater is better.
TOKEN = 1 << 32
POINTS = 0x110000  #: code points
#: Tokens and pre-tokens are one number too.
CHUNK = 1 << 36


class UnigramTrie:
    """nodes: kept before the trie starts anew; kept: chunks whose counts are remembered, and as many that were used
    before those, so that a new trie needn't count frequent words again; deepest: characters of the longest pre-token
    put on the trie."""

    def __init__(self, scores: dict[str, int], nodes: int = 500_000, kept: int = 400_000, deepest: int = 128):
        self.scores = {piece: s * TOKEN - 1 for piece, s in scores.items()}
        self.longest = max(map(len, scores), default=1)
        self.unknown = (min(scores.values(), default=0) - 10_000_000) * TOKEN
        self.most, self.kept, self.deepest = nodes, kept, deepest
        self.chunks: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        #: node * POINTS + character -> node; one flat table, so that the collector has no containers to walk
        self.edges: dict[int, int] = {}
        self.forward: list[int] = [0]
        self.terminal: dict[str, int] = {}

    def extend(self, word: str, d: int, path: list[int]) -> int:
        """Best score of word[:d + 1]; path[i] is that of word[:i]."""
        best = path[d] + self.unknown - len(word[d].encode("utf-8", "surrogatepass"))
        known, end, start = self.scores.get, d + 1, max(0, d + 1 - self.longest)
        for before in path[start:end]:
            s = known(word[start:end])
            if s is not None and before + s > best:
                best = before + s
            start += 1
        return best

    def count(self, word: str) -> int:
        if (n := self.terminal.get(word)) is not None:
            return n
        if len(word) > self.deepest:
            return self.plain(word)
        if len(self.forward) > self.most:
            self.clear()
        edges, forward, node, path = self.edges, self.forward, 0, [0]
        for d, c in enumerate(map(ord, word)):
            edge = node * POINTS + c
            node = edges.get(edge)
            if node is None:
                node = edges[edge] = len(forward)
                forward.append(self.extend(word, d, path))
            path.append(forward[node])
        n = self.terminal[word] = -path[-1] % TOKEN
        return n

    def tally(self, chunk: str) -> int:
        """Tokens and, in the low bits, pre-tokens of what stands between two spaces."""
        n = self.older.get(chunk)
        if n is None:
            parts = PRETOKEN.findall(SPACE + chunk)
            n = sum(map(self.count, parts)) * CHUNK + len(parts)
        if len(chunk) <= self.deepest:
            if len(self.chunks) >= self.kept:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """Tokens and pre-tokens of a text. No pre-token reaches over a space, so those between spaces are summed."""
        if not text:
            return 0, 0
        tally, both = self.tally, 0
        for c, k in Counter(text.split(" ")).items():
            both += k * (self.chunks.get(c) or tally(c))
        return both // CHUNK, both % CHUNK

    def plain(self, word: str) -> int:
        """The same without the trie, with the last `longest` scores at hand."""
        recent = [0]
        for d in range(len(word)):
            shift = d + 1 - len(recent)
            window = word[shift : d + 1]
            recent.append(self.extend(window, len(window) - 1, recent))
            if len(recent) > self.longest:
                recent.pop(0)
        return -recent[-1] % TOKEN


_tries: dict[str, UnigramTrie] = {}


def trie(model_file: str) -> UnigramTrie:
    if model_file not in _tries:
        _tries[model_file] = UnigramTrie(piece_scores(model_file))
    return _tries[model_file]


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, n_pretokens."""

    def run(batch: pa.RecordBatch):
        t = trie(model_file)
        tokens, pre = [], []
        for text in texts(batch.column(1)):
            n, m = t.text(text)
            tokens.append(n)
            pre.append(m)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tokens, pa.int64()), pa.array(pre, pa.int64())], ["id", "n_tokens", "n_pretokens"]
        )

    kind = df.schema[id_col].dataType.simpleString()
    out = map_rows(df.select(id_col, text_col), run, f"id {kind}, n_tokens bigint, n_pretokens bigint")
    return out.withColumnRenamed("id", id_col)
