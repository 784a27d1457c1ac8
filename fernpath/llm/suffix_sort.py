"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries where strings still agree."""

from __future__ import annotations

import numpy as np

SHALLOW = 32
_KEY = 8


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Sorted strings as a trie that keeps only where they part. A string is first led down by those bytes alone; what it
    really shares with the leaf it meets tells where it belongs."""

    def __init__(self):
        self.root = None  # a leaf: [string, rows]; a branch: (depth, {byte or -1 at a string's end: node})

    def add(self, string: bytes, row: int) -> None:
        if self.root is None:
            self.root = [string, [row]]
            return
        node = self.root
        while type(node) is tuple:
            depth, kids = node
            node = kids.get(string[depth] if depth < len(string) else -1) or next(iter(kids.values()))
        shared = common(string, node[0])
        if shared == len(string) == len(node[0]):
            node[1].append(row)
            return
        other = node[0][shared] if shared < len(node[0]) else -1
        mine = string[shared] if shared < len(string) else -1
        above, node = None, self.root
        while type(node) is tuple and node[0] <= shared:
            depth, kids = node
            if depth == shared:
                kids[mine] = [string, [row]]
                return
            above = (kids, string[depth])
            node = kids[string[depth]]
        fork = (shared, {other: node, mine: [string, [row]]})
        if above is None:
            self.root = fork
        else:
            above[0][above[1]] = fork

    def sorted(self) -> tuple[list[int], list[int]]:
        """Rows in order of their strings, and for each what it shares with the one before (the first: 0)."""
        rows, shared, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if type(node) is tuple:
                kids = sorted(node[1].items())
                stack += [(kid, node[0]) for _, kid in reversed(kids[1:])] + [(kids[0][1], before)]
            else:
                rows += node[1]
                shared += [before] + [len(node[0])] * (len(node[1]) - 1)
        return rows, shared


def _first_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes eight-byte keys share."""
    bits, equal = x ^ y, np.full(len(x), _KEY)
    for b in range(_KEY - 1, -1, -1):
        equal[(bits >> np.uint64(8 * (_KEY - 1 - b))) & np.uint64(255) != 0] = b
    return equal


def _multikey(head: np.ndarray, inside: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows that `order` brings by group: their new order, and where a run of rows with equal keys begins.

    A run of rows (one group, equal so far) is parted in three by a pivot of its own in the present key: smaller ones, equal ones,
    which go on to the next key, and larger ones. All runs take a step at once. A string's end comes before any byte.
    """
    n = len(order)
    first = np.concatenate(([True], np.diff(group[order]) != 0)) if n else np.zeros(0, bool)
    depth = np.zeros(n, np.int64)  # by place: the key that its run is sorted by next
    while True:
        run = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        at = np.flatnonzero((size[run] > 1) & (depth < head.shape[1]))
        if not len(at):
            return order, first
        row, k = order[at], depth[at]
        pivot = order[(start + size // 2)[run[at]]]
        key, other, end, end_ = head[row, k], head[pivot, k], inside[row, k], inside[pivot, k]
        side = np.where((key == other) & (end == end_), 1, np.where((key < other) | ((key == other) & (end < end_)), 0, 2))
        part = run[at] * 3 + side
        by = np.argsort(part, kind="stable")
        order[at] = row[by]
        part = part[by]
        first[at[1:]] |= part[1:] != part[:-1]
        # equal rows whose strings all end within the key are done
        depth[at] += np.where(part % 3 == 1, np.where(end[by] < _KEY, head.shape[1], 1), 0)


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups (groups in order of their numbers), and what each shares with the one before.

    Where a group begins, the share is -1. Ties keep the order of the rows.
    """
    n = len(strings)
    length = np.fromiter(map(len, strings), np.int64, n)
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64) if n else np.zeros((0, 1), np.uint64)
    inside = np.clip(length[:, None] - np.arange(head.shape[1]) * _KEY, 0, _KEY)
    order, first = _multikey(head, inside, np.argsort(group, kind="stable"), group)
    shared = np.full(n, -1)
    if n:
        new = np.concatenate(([True], np.diff(group[order]) != 0))
        low, high = order[:-1], order[1:]
        share, open_ = np.zeros(n - 1, np.int64), np.ones(n - 1, bool)
        for k in range(head.shape[1]):
            part = np.minimum(_first_difference(head[low, k], head[high, k]), np.minimum(inside[low, k], inside[high, k]))
            share += np.where(open_, part, 0)
            open_ &= part == _KEY
        shared[1:] = np.where(new[1:], -1, share)
    starts = np.nonzero(first)[0]
    ends = np.append(starts[1:], n)
    for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        trie = BlindTrie()
        for row in order[s:e].tolist():
            trie.add(strings[row], row)
        order[s:e], found = trie.sorted()
        shared[s + 1 : e] = found[1:]
    return order, shared
