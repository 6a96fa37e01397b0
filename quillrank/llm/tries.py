"""Tries of strings and their traversal by Levenshtein automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Trie:
    """A set of strings; ``near`` walks it with the automaton of a query and cuts branches it cannot accept."""

    __slots__ = ("root",)

    def __init__(self, strings: Iterable[str] = ()):
        self.root: dict = {}
        for s in strings:
            self.add(s)

    def add(self, s: str) -> None:
        node = self.root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = s

    def near(self, query: str, most: int) -> Iterator[tuple[str, int]]:
        """(string, distance) of all within ``most`` edits: insert, drop, change, or swap of neighbours.

        State e of the automaton holds, as bits, how many letters of the query can be matched with e edits.
        """
        n, k = len(query), most
        at: dict[str, int] = {}
        for i, c in enumerate(query):
            at[c] = at.get(c, 0) | 1 << (i + 1)
        full = (1 << (n + 1)) - 1
        start = [(1 << (e + 1)) - 1 & full for e in range(k + 1)]
        stack: list[tuple[dict, list[int], list[int] | None, int]] = [(self.root, start, None, 0)]
        while stack:
            node, now, past, seen = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e in range(k + 1):
                        if now[e] >> n & 1:
                            yield child, e
                            break
                    continue
                hit = at.get(c, 0)
                new = [(now[0] << 1) & hit]
                for e in range(1, k + 1):
                    x = ((now[e] << 1) & hit) | now[e - 1] | (now[e - 1] << 1) | (new[e - 1] << 1)
                    if past is not None:
                        x |= (((past[e - 1] << 1) & hit) << 1) & seen
                    new.append(x & full)
                if new[k]:
                    stack.append((child, new, now, hit))


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, or ``most`` + 1 if there are more."""
    return next((d for _, d in Trie([a]).near(b, most)), most + 1)
