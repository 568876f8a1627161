"""Measures of a text's words and lines, for rules and labellers."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

SYMBOLS = b"#*$%&|<>"
_SYMBOL_ONLY = bytes(b for b in range(256) if b not in SYMBOLS)
_BLANK = b" \t\n\r\x0b\x0c"
_NOT_BLANK_OR_TAIL = bytes(b for b in range(256) if b in _BLANK or 128 <= b < 192)
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    distinct: list[bytes]  #: words, by number
    numbers: np.ndarray  #: of the words; equal words have equal numbers


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(numbers)
    if n < 4:
        return 0
    top = np.int64(numbers.max()) + 1
    if top < 2_000_000:
        key = (numbers[:-2] * top + numbers[1:-1]) * top + numbers[2:]
    else:
        key = np.unique(np.stack((numbers[:-2], numbers[1:-1], numbers[2:]), 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= again
    inside[1:-1] |= again
    inside[2:] |= again
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x and x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measure(text: str | None) -> Measures:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # on exactly the blanks \x20 and \x09 to \x0D
    ids: dict[bytes, int] = {}
    add = ids.setdefault
    numbers = np.array([add(w, len(ids)) for w in words], np.int64)
    return Measures(
        len(words),
        len(data.translate(None, _NOT_BLANK_OR_TAIL)),
        len(data.translate(None, _SYMBOL_ONLY)),
        duplicate_lines(data),
        repeated_words(numbers),
        list(ids),
        numbers,
    )
