"""Codes of 64 bits in Gray-code order, and the tree that finds those that differ in few bits.

The sorted codes of a node are the leaves; every upper node holds the bits that all codes
below it share (mask and pattern).  Pairs of nodes are followed downwards.  The
differences in the bits that both mask are a lower bound of all pairs below, so whole
groups go as soon as it passes the limit, whole groups are linked at once where even all
unshared bits cannot pass it, and whole groups that are linked already are left alone.
"""

from __future__ import annotations

import numpy as np

from .components import local_labels

#: Nodes below an upper node.
FAN = 8


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _tree(node: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the leaves up: first and last child, mask, pattern, node key, and the leaves below (low, high)."""
    every = np.arange(len(codes))
    levels = [(every, every + 1, np.full(len(codes), ~np.uint64(0)), codes, node, every, every + 1)]
    while True:
        _, _, mask, pattern, key, low, high = levels[-1]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        if len(start) == len(key):
            return levels
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        head = np.flatnonzero(place % FAN == 0)
        tail = np.r_[head[1:], len(key)]
        ones = np.bitwise_and.reduceat(pattern & mask, head)
        zeros = np.bitwise_and.reduceat(~pattern & mask, head)
        levels.append((head, tail, ones | zeros, ones, key[head], low[head], high[tail - 1]))


class _Groups:
    """Which leaves are linked already, and the label of each node whose leaves all are."""

    def __init__(self, levels):
        self.levels, self.label = levels, np.arange(len(levels[0][0]))
        self._common()

    def _common(self) -> None:
        self.common = []
        for k, level in enumerate(self.levels):
            if k == 0:
                self.common.append(self.label)
            elif len(level[5]):
                least, most = (f.reduceat(self.label, level[5]) for f in (np.minimum, np.maximum))
                self.common.append(np.where(least == most, least, -1))
            else:
                self.common.append(np.zeros(0, int))

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        apart = x != y
        if apart.any():
            self.label = local_labels(len(self.label), x[apart], y[apart])[self.label]
            self._common()

    def linked(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.common[k][a]
        return (x >= 0) & (x == self.common[k][b])


def linked(node: np.ndarray, codes: np.ndarray, limit: int = 3, wide: np.ndarray | None = None, wide_limit: int = 0, chunk: int = 200_000):
    """Pairs of indices of the same node that connect what is linked, not all linked pairs.

    Two codes are linked if they differ in at most ``limit`` bits and, with ``wide`` (64
    more bits of each), in at most ``wide_limit`` of all 128.
    """
    order = np.lexsort((gray_rank(codes), node))
    node, codes = node[order], codes[order]
    if wide is not None:
        wide = wide[order]

    def near(a, b):
        apart = np.bitwise_count(codes[a] ^ codes[b])
        if wide is None:
            return apart <= limit
        return (apart <= limit) & (apart + np.bitwise_count(wide[a] ^ wide[b]) <= wide_limit)

    levels = _tree(node, codes)
    groups = _Groups(levels)
    side = np.flatnonzero(node[1:] == node[:-1]) if len(node) else np.zeros(0, int)
    side = side[near(side, side + 1)]  # neighbours in Gray order: most of a dense group
    groups.join(side, side + 1)
    yield order[side], order[side + 1]
    tops = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, tops, tops)]
    while stack:
        k, a, b = stack.pop()
        if len(a) > chunk:
            stack += [(k, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
            continue
        new = ~groups.linked(k, a, b)
        a, b = a[new], b[new]
        if k == 0:
            close = near(a, b)
            a, b = a[close], b[close]
            if len(a):
                groups.join(a, b)
                yield order[a], order[b]
            continue
        first, last, mask, pattern, _, low, high = levels[k]
        both = mask[a] & mask[b]
        least = np.bitwise_count((pattern[a] ^ pattern[b]) & both)
        keep = least <= limit
        a, b, most = a[keep], b[keep], (np.bitwise_count(~both) + least)[keep]
        if wide is None:
            whole = most <= limit
            spans = [np.unique(np.r_[low[x] : high[x], low[y] : high[y]]) for x, y in zip(a[whole], b[whole], strict=True)]
            if spans:
                one, two = (np.concatenate(x) for x in zip(*((s[:-1], s[1:]) for s in spans), strict=True))
                groups.join(one, two)
                yield order[one], order[two]
            a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        tall = last[b] - first[b]
        per = (last[a] - first[a]) * tall
        at = np.repeat(np.arange(len(a)), per)
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        x, y = first[a][at] + inner // tall[at], first[b][at] + inner % tall[at]
        keep = x <= y
        stack.append((k - 1, x[keep], y[keep]))
