"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what still agrees there."""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort looks at before a group goes to a blind trie, in words of 8.
SHALLOW_BYTES = 32
_SMALL = 24


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders strings by a trie whose edges keep one byte: a string is compared with a single leaf, then hung in where it leaves it."""

    def __init__(self) -> None:
        # A node is [depth, children by next byte (-1: the string ends here)]; a leaf is a list of equal strings' numbers.
        self.root: list | None = None
        self.strings: list[bytes] = []

    def insert(self, number: int, string: bytes) -> None:
        self.strings.append(string)
        mine = (len(self.strings) - 1, [number])
        if self.root is None:
            self.root = mine
            return
        node = self.root
        while isinstance(node, list):  # blind descent: bytes between branches are not looked at
            c = string[node[0]] if node[0] < len(string) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        if other == string:
            node[1].append(number)
            self.strings.pop()
            return
        depth = common_prefix(other, string)
        parent, edge, node = None, None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, edge = node, string[node[0]] if node[0] < len(string) else -1
            node = node[1][edge]
        c = string[depth] if depth < len(string) else -1
        if isinstance(node, list) and node[0] == depth:
            node[1][c] = mine
            return
        old = other[depth] if depth < len(other) else -1
        branch = [depth, {old: node, c: mine}]
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the common prefix of each with the one before it (0 for the first)."""
        numbers: list[int] = []
        shared: list[int] = []
        todo = [(self.root, 0)] if self.root is not None else []
        while todo:
            node, before = todo.pop()
            if isinstance(node, list):
                edges = sorted(node[1])
                todo += [(node[1][c], node[0] if k else before) for k, c in reversed(list(enumerate(edges)))]
            else:
                numbers += node[1]
                shared += [before] + [len(self.strings[node[0]])] * (len(node[1]) - 1)
        return numbers, shared


def _quicksort(words: np.ndarray, rows: np.ndarray, depth: int, groups: list[np.ndarray]) -> None:
    """Append to ``groups``, in order, the rows that agree in all words."""
    todo = [(rows, depth)]
    while todo:
        rows, depth = todo.pop()
        if depth == words.shape[1] or len(rows) == 1:
            groups.append(rows)
            continue
        column = words[rows, depth]
        if len(rows) <= _SMALL:
            order = np.argsort(column, kind="stable")
            rows, column = rows[order], column[order]
            cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
            todo += [(part, depth + 1) for part in reversed(np.split(rows, cuts))]
            continue
        pivot = np.sort(column[:: max(1, len(column) // 9)])[4 if len(column) >= 9 else len(column) // 2]
        less, same, more = rows[column < pivot], rows[column == pivot], rows[column > pivot]
        todo += [(part, d) for part, d in ((more, depth), (same, depth + 1), (less, depth)) if len(part)]


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW_BYTES) -> tuple[list[int], list[int]]:
    """The numbers of ``strings`` in byte order, and the common prefix of each with the one before it."""
    if not strings:
        return [], []
    packed = b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings)
    words = np.frombuffer(packed, ">u8").reshape(len(strings), shallow // 8).astype(np.uint64)
    groups: list[np.ndarray] = []
    _quicksort(words, np.arange(len(strings)), 0, groups)
    order: list[int] = []
    shared: list[int] = []
    for group in groups:
        if len(group) == 1:
            numbers, inner = [int(group[0])], [0]
        else:
            trie = BlindTrie()
            for k in group.tolist():
                trie.insert(k, strings[k])
            numbers, inner = trie.ordered()
        if order:
            inner[0] = common_prefix(strings[order[-1]], strings[numbers[0]])
        order += numbers
        shared += inner
    return order, shared
