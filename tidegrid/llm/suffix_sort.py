"""Hash-compared sorting of many short strings, in numpy.

Prefix polynomial hashes compare any two substrings in one step, so the common extension of two strings takes a binary
search, and a comparison in the mergesort a logarithmic number of steps. Hashes can collide; the sorted order and the
common prefixes of neighbours are therefore verified byte by byte, and a collision repeats the sort with another base.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers, tried one after another.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5, 0xA0761D6478BD642F)


class Strings:
    """Strings laid end to end in ``data``; string i begins at ``start[i]`` and has ``length[i]`` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, base: int):
        self.data = np.r_[data, np.uint8(0)]  # one more byte, so that the place after the last string can be looked up
        self.start, self.length, self.group = start, length, group
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), base, np.uint64)])
        self.prefix = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:-1])]
        self.steps = int(length.max(initial=0)).bit_length()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings a and b, by binary search on hashes."""
        x, y = self.start[a], self.start[b]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        px, py, wx, wy = self.prefix[x], self.prefix[y], self.power[y], self.power[x]
        for _ in range(self.steps + 1):
            mid = (low + high + 1) >> 1
            same = (self.prefix[x + mid] - px) * wx == (self.prefix[y + mid] - py) * wy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(high, low)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes before b: by group, then by bytes, a prefix first."""
        out = self.group[a] < self.group[b]
        at = np.flatnonzero(self.group[a] == self.group[b])
        if len(at):
            a, b = a[at], b[at]
            n = self.common(a, b)
            short = n == np.minimum(self.length[a], self.length[b])
            i, j = self.start[a] + np.where(short, 0, n), self.start[b] + np.where(short, 0, n)
            out[at] = np.where(short, self.length[a] < self.length[b], self.data[i] < self.data[j])
        return out

    def sorted(self) -> np.ndarray:
        """The order of the strings, by a bottom-up mergesort whose merges run side by side."""
        n = len(self.start)
        order, width = np.arange(n), 1
        while width < n:
            at = np.arange(n)
            block = at // (2 * width) * (2 * width)
            own_left = at - block < width
            base = np.minimum(np.where(own_left, block + width, block), n)
            end = np.minimum(np.where(own_left, block + 2 * width, block + width), n)
            low, high = base.copy(), end.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                mine, other, left = order[open_], order[mid], own_left[open_]
                first = np.where(left, other, mine)
                second = np.where(left, mine, other)
                before = self.less(first, second) ^ ~left  # left: other < mine; right: not mine < other
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = np.where(own_left, at, at - width) + low - base
            merged = np.empty(n, order.dtype)
            merged[place] = order
            order, width = merged, 2 * width
        return order


def _byte_common(s: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix of strings a and b, by their bytes."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    most = np.minimum(s.length[a], s.length[b])
    for k in range(int(most.max(initial=0))):
        live = live[most[live] > k]
        live = live[s.data[s.start[a[live]] + k] == s.data[s.start[b[live]] + k]]
        out[live] = k + 1
    return out


def sort_strings(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings by group and bytes, and each one's common prefix with the one before (-1 in a new group)."""
    for base in _BASES:
        s = Strings(data, start, length, group, base)
        order = s.sorted()
        a, b = order[:-1], order[1:]
        common = np.r_[-1, np.where(group[a] == group[b], s.common(a, b), -1)]
        same = np.flatnonzero(group[a] == group[b])
        a, b = a[same], b[same]
        exact = _byte_common(s, a, b)
        ends = exact == np.minimum(length[a], length[b])
        ordered = np.where(ends, length[a] <= length[b], s.data[start[a] + exact] < s.data[start[b] + exact])
        if (exact == common[same + 1]).all() and ordered.all() and (np.diff(group[order]) >= 0).all():
            return order, common
    raise ArithmeticError("hashes collided under every base")
