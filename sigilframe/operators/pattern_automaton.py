"""Many patterns at once: a trie of signs with failure links.

A node is the longest end of the signs so far that begins some pattern; one transition a sign leads to the next, however
many patterns there are. A node knows the longest pattern that ends there, and its chain of failure links all prefixes
that its signs end with.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class PatternAutomaton:
    """Of patterns (name, signs) in order; of those with equal signs the first counts. Signs beyond max_length are never
    together in a buffer, so longer patterns are begun but don't end."""

    def __init__(self, patterns: Iterable[tuple[str, tuple[str, ...]]], max_length: int = 16):
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.fail = [0], [0]
        own: list[tuple[str, int] | None] = [None]
        self.begins: list[list[int]] = [[]]
        self.names = []
        for place, (name, signs) in enumerate(patterns):
            self.names.append(name)
            node = 0
            for sign in signs[:max_length]:
                if sign not in self.next[node]:
                    self.next[node][sign] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    own.append(None)
                    self.begins.append([])
                    self.fail.append(0)
                node = self.next[node][sign]
                self.begins[node].append(place)
            if 0 < len(signs) <= max_length and own[node] is None:
                own[node] = name, len(signs)
        self.longest = own
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            if self.longest[node] is None:
                self.longest[node] = self.longest[self.fail[node]]
            for sign, below in self.next[node].items():
                self.fail[below] = self.step(self.fail[node], sign)
                queue.append(below)

    def step(self, node: int, sign: str) -> int:
        """The node after one more sign."""
        while node and sign not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(sign, 0)

    def ends(self, node: int) -> list[tuple[int, int]]:
        """The node and those of all shorter prefixes that its signs end with, each with its depth."""
        out = []
        while node:
            out.append((node, self.depth[node]))
            node = self.fail[node]
        return out
