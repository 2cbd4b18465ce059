"""Signature trees: exact similarity joins of sets within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Sets in order of size band and least element, grouped by FANOUT again and again.

    A node holds the bitmap of all tokens below it (OR), the range of set sizes and the least number of
    bits that any one set below it has. Level 0 are the sets themselves.
    """

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        band = np.floor(np.log(np.maximum(sizes, 1)) / max(1e-6, np.log(100 / percent))).astype(np.int64)
        self.order = np.lexsort((sizes, [int(s[0]) if len(s) else 0 for s in sets], band))
        bits = 64
        while bits < min(8192, 2 * int(sizes.max(initial=1))):
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            at = (sets[i] >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = sizes[self.order]
        self.levels = [(maps, size, size, np.bitwise_count(maps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, least = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(least, at)))
        self.percent = percent

    def possible(self, level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a pair of sets that is similar enough."""
        maps, low, high, least = self.levels[level]
        ok = (100 * np.minimum(high[p], high[q]) >= self.percent * np.maximum(low[p], low[q])).nonzero()[0]
        p2, q2 = p[ok], q[ok]
        common = np.bitwise_count(maps[p2] & maps[q2]).sum(1, dtype=np.int64)
        # a bit of one set that the other node lacks stands for at least one token outside the intersection
        most = np.minimum(high[p2] - np.maximum(0, least[p2] - common), high[q2] - np.maximum(0, least[q2] - common))
        out = np.zeros(len(p), bool)
        out[ok] = most >= needed(low[p2], low[q2], self.percent)
        return out

    def pairs(self, labels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs of positions in ``order``, by dual traversal from the root.

        ``labels()`` gives the current component of each position; pairs of nodes that lie in one and the
        same component hold nothing new and are left out.
        """
        top = len(self.levels) - 1
        block = max(64, (1 << 22) // (FANOUT * FANOUT * self.levels[0][0].shape[1]))
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, p, q = stack.pop()
            if len(p) > block:
                stack.append((level, p[block:], q[block:]))
                p, q = p[:block], q[:block]
            low = high = labels()
            for _ in range(level):
                at = np.arange(0, len(low), FANOUT)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            new = ~((low[p] == high[p]) & (low[q] == high[q]) & (low[p] == low[q]))
            p, q = p[new], q[new]
            if not len(p):
                continue
            keep = self.possible(level, p, q)
            p, q = p[keep], q[keep]
            if level == 0:
                yield p, q
                continue
            n = len(self.levels[level - 1][0])
            child = np.arange(FANOUT)
            a, b = np.broadcast_arrays((p * FANOUT)[:, None, None] + child[None, :, None], (q * FANOUT)[:, None, None] + child[None, None, :])
            a, b = a.ravel(), b.ravel()
            inside = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            stack.append((level - 1, a[inside], b[inside]))


def linked_components(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> np.ndarray:
    """For each set the position of the first set of its component; ``labels``: components known before.

    Two sets link when 100 * intersection >= percent * union; empty sets link with nothing. Pairs whose
    sets are connected already are not compared, so a large group of near copies takes about one
    comparison a set, and a group that does not hold together only those that the tree can't rule out.
    """
    n = len(sets)
    parent = np.arange(n)
    if labels is not None:
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        parent = first[at]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def link(i: int, j: int) -> None:
        x, y = sets[i], sets[j]
        if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return
        a, b = find(i), find(j)
        if a == b:
            return
        common = len(x) + len(y) - len(np.union1d(x, y))
        if 100 * common >= percent * (len(x) + len(y) - common):
            parent[max(a, b)] = min(a, b)

    if n > 1:
        tree = SignatureTree(sets, percent)
        order = tree.order
        for i, j in zip(order[:-1].tolist(), order[1:].tolist()):  # neighbours in the tree first
            link(i, j)
        middle = int(order[n // 2])
        for i in order.tolist():
            link(i, middle)

        def roots() -> np.ndarray:
            while True:
                up = parent[parent]
                if (up == parent).all():
                    return parent[order]
                parent[:] = up

        for p, q in tree.pairs(roots):
            for i, j in zip(order[p].tolist(), order[q].tolist()):
                link(i, j)
    return np.array([find(i) for i in range(n)], np.int64)
