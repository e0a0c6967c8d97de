"""Suffix trees of sequences of small integers, with longest common extensions in constant time.

The tree is built by Ukkonen's algorithm. Its Euler tour, cut down to the least depth between neighbouring leaves, is kept as a table of
minima over powers of two, so the lowest common ancestor of any two suffixes, which is the length of their common beginning, is two
look-ups; they are made for many pairs at once.
"""

from __future__ import annotations

import numpy as np


def build(s: list[int], symbols: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last symbol occurs once. Symbols are 0 to ``symbols - 1``.

    Returns the children by (node * symbols + first symbol), and each node's first and past-the-last place of its edge; leaves
    end at the end of ``s``.
    """
    n = len(s)
    child: dict[int, int] = {}
    first, past, link = [0], [0], [0]
    node, edge, length = 0, 0, 0  # the active point: its node, where its edge's text begins, how far it is along
    pending = 0
    for i in range(n):
        c = s[i]
        pending += 1
        inner = 0  # the inner node that still needs its suffix link
        while pending:
            if not length:
                edge = i
            slot = node * symbols + s[edge]
            below = child.get(slot)
            if below is None:
                child[slot] = len(first)
                first.append(i)
                past.append(n)
                link.append(0)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                a = first[below]
                b = past[below]
                span = (b if b < i else i) - a
                if b <= i and length >= span:
                    node = below
                    edge += span
                    length -= span
                    continue
                if s[a + length] == c:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                split = len(first)
                first.append(a)
                past.append(a + length)
                link.append(0)
                child[slot] = split
                child[split * symbols + c] = split + 1
                first.append(i)
                past.append(n)
                link.append(0)
                first[below] = a + length
                child[split * symbols + s[a + length]] = below
                if inner:
                    link[inner] = split
                inner = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return child, first, past


class Extensions:
    """Longest common extensions of the suffixes of ``s`` (integers from 1 on; 0 is the end, below all others)."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        symbols = int(s.max()) + 1 if n else 1
        child, first, past = build([*s.tolist(), 0], symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        del child
        self.parent = np.empty(len(first), np.int64)
        self.parent[0] = 0
        self.symbol = np.zeros(len(first), np.int64)
        self.parent[below], self.symbol[below] = keys // symbols, keys % symbols
        self.width = np.array(past, np.int64) - np.array(first, np.int64)
        self.leaf = np.array(past, np.int64) == n + 1
        self.leaf[0] = False
        self.order, self.lows = self._tour(1)
        self.place = np.empty(n + 1, np.int64)
        self.place[self.order] = np.arange(n + 1)
        self.table = self._minima(self.lows)

    def _tour(self, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of an Euler tour, and between neighbours the least depth passed.

        The children of a node are visited by first symbol, or, with ``sign`` -1, from the greatest down, but the end first.
        """
        symbol = self.symbol if sign == 1 else np.where(self.symbol > 0, self.symbol.max() + 1 - self.symbol, 0)
        nodes = np.arange(1, len(self.parent))
        nodes = nodes[np.lexsort((symbol[1:], self.parent[1:]))]
        counts = np.bincount(self.parent[nodes], minlength=len(self.parent))
        begin = (np.cumsum(counts) - counts).tolist()
        end = np.cumsum(counts).tolist()
        nodes, width, leaf = nodes.tolist(), self.width.tolist(), self.leaf.tolist()
        order, lows = [], []
        total, low = self.n + 1, 0
        at, depths, depth = [begin[0]], [], 0  # the open nodes' next children, the depths above, and the depth of the last
        here = [end[0]]
        while at:
            k = at[-1]
            if k == here[-1]:
                at.pop()
                here.pop()
                if at:
                    depth = depths.pop()
                    if depth < low:
                        low = depth
                continue
            at[-1] = k + 1
            node = nodes[k]
            if leaf[node]:
                order.append(total - depth - width[node])
                lows.append(low)
                low = depth
            else:
                depths.append(depth)
                depth += width[node]
                at.append(begin[node])
                here.append(end[node])
        return np.array(order, np.int64), np.array(lows, np.int32)

    @staticmethod
    def _minima(lows: np.ndarray) -> list[np.ndarray]:
        table, step = [lows], 1
        while 2 * step <= len(lows):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def ranks(self, sign: int = 1) -> np.ndarray:
        """The rank of each suffix (the empty one too), in the order of the symbols or, with ``sign`` -1, in the opposite one."""
        if sign == 1:
            return self.place
        place = np.empty(self.n + 1, np.int64)
        place[self._tour(-1)[0]] = np.arange(self.n + 1)
        return place

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``i`` and at ``j``, which differ pair by pair and are at most n."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # minima over lows[low:high]
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] - (1 << k)])
        return out
