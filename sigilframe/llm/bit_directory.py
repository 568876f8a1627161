"""Packed bit vectors with a directory of block popcounts: rank and select for many places at once."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits in a block of the directory.
BLOCK = 8


class BitDirectory:
    """Bits in words of 64, least bit first, and for each block of 512 bits the ones before it.

    rank(i) counts the ones before place i; select(k) is the place of the k-th one, k from 1 to total.
    """

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(-(-len(packed) // (8 * BLOCK)) * BLOCK + BLOCK, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        each = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        self.total = int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        at = np.asarray(places, np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK
        row = np.bitwise_count(self.words[block[:, None] * BLOCK + np.arange(BLOCK)])
        whole = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], row, 0).sum(1, dtype=np.int64)
        part = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[block] + whole + part

    def select(self, ranks: np.ndarray) -> np.ndarray:
        k = np.asarray(ranks, np.int64)
        if not len(k):
            return k
        block = np.searchsorted(self.before, k, "left") - 1
        k = k - self.before[block]
        row = np.cumsum(np.bitwise_count(self.words[block[:, None] * BLOCK + np.arange(BLOCK)]), 1, dtype=np.int64)
        inside = (row < k[:, None]).sum(1)
        k = k - np.where(inside > 0, row[np.arange(len(k)), inside - 1], 0)
        word = block * BLOCK + inside
        ones = np.cumsum(np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 1)
        return word * 64 + (ones < k[:, None]).sum(1)
