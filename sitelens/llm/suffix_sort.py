"""Deep-shallow sorting of suffixes, with the common prefixes of neighbours.

Shallow: multikey quicksort compares eight bytes at a time and stops at a fixed
depth.  Deep: every group that still agrees there goes into a blind (Patricia)
trie, which looks at branching bytes only, compares each suffix with a single
leaf, and read in order gives the sorted group and its common prefix lengths.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64


class Suffixes:
    """Byte strings of bounded length as rows of a matrix."""

    def __init__(self, rows: list[bytes], width: int) -> None:
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        self.width = -(-max(1, width) // 8) * 8
        flat = b"".join(r.ljust(self.width, b"\0") for r in rows)
        self.bytes = np.frombuffer(flat, np.uint8).reshape(len(rows), self.width)
        self.words = np.frombuffer(flat, ">u8").reshape(len(rows), self.width // 8).astype(np.uint64)
        self.rows = rows

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix of two rows."""
        n = int(min(self.length[i], self.length[j]))
        a, b = self.rows[i], self.rows[j]
        if a[:n] == b[:n]:
            return n
        return int((self.bytes[i, :n] != self.bytes[j, :n]).argmax())


def multikey(s: Suffixes, depth: int) -> list[np.ndarray]:
    """Rows in order of their first ``depth`` bytes: groups that agree on them.

    An explicit stack replaces the recursion; parts are split into less, equal
    and greater around the middle word of the part, and equal parts go on with
    the next word.
    """
    groups: list[np.ndarray] = []
    last = min(depth, s.width) // 8
    stack = [(np.arange(len(s.rows)), 0)]
    while stack:
        part, word = stack.pop()
        if len(part) < 2 or word == last:
            if len(part):
                groups.append(part)
            continue
        key = s.words[part, word]
        low, high = key.min(), key.max()
        if low == high:
            stack.append((part, word + 1))
            continue
        if len(part) > 64:
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            stack.append((part[key > pivot], word))
            stack.append((part[key == pivot], word + 1))
            stack.append((part[key < pivot], word))
        else:  # few rows left: order them by this word and go on with runs of equal ones
            by = np.argsort(key, kind="stable")
            part, key = part[by], key[by]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for run in reversed(np.split(part, cuts)):
                stack.append((run, word + 1))
    return groups


class BlindTrie:
    """A trie of branching positions; a byte past the end of a row sorts first."""

    __slots__ = ("s", "root")

    def __init__(self, s: Suffixes, first: int) -> None:
        self.s = s
        self.root: list = [None, [first]]  # leaf: [None, equal rows]; node: [position, {byte: child}]

    def _byte(self, row: int, at: int) -> int:
        text = self.s.rows[row]
        return text[at] if at < len(text) else -1

    def insert(self, row: int) -> None:
        node = self.root
        while node[0] is not None:  # blind descent: any child will do when the byte is new
            child = node[1].get(self._byte(row, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        leaf = node[1][0]
        same = self.s.common(row, leaf)
        if same == len(self.s.rows[row]) == len(self.s.rows[leaf]):
            node[1].append(row)
            return
        node, parent, edge = self.root, None, None
        while node[0] is not None and node[0] < same:
            edge = self._byte(row, node[0])
            parent, node = node, node[1][edge]
        if node[0] == same:
            node[1][self._byte(row, same)] = [None, [row]]
            return
        split = [same, {self._byte(leaf, same): node, self._byte(row, same): [None, [row]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def in_order(self) -> tuple[list[int], list[int]]:
        """Rows in order, and of each the common prefix with the row before (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                for k, row in enumerate(node[1]):
                    order.append(row)
                    common.append(before if k == 0 else len(self.s.rows[row]))
                continue
            children = sorted(node[1].items(), reverse=True)
            for k, (_, child) in enumerate(children):
                stack.append((child, before if k == len(children) - 1 else node[0]))
        return order, common


def deep_shallow(rows: list[bytes], width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (at most ``width`` bytes each; an end sorts before any
    byte) and the common prefix of each with the row before it."""
    n = len(rows)
    order = np.empty(n, np.int64)
    common = np.zeros(n, np.int64)
    if not n:
        return order, common
    s = Suffixes(rows, width)
    at = 0
    for group in multikey(s, shallow):
        if len(group) == 1:
            order[at] = group[0]
        else:
            trie = BlindTrie(s, int(group[0]))
            for row in group[1:].tolist():
                trie.insert(row)
            o, c = trie.in_order()
            order[at:at + len(o)] = o
            common[at:at + len(c)] = c
        if at:
            common[at] = s.common(int(order[at - 1]), int(order[at]))
        at += len(group)
    return order, common
