"""Hierarchical index over bit codes in Gray order.

A code has a first lane of 64 bits, on which two codes must agree, and further lanes, in which they may differ by some
bits. Codes are sorted by their rank in the Gray code of all lanes together, so neighbours share long bit patterns. A
node stands for up to ``FANOUT`` neighbours: its mask marks the bits on which all of them agree, its pattern holds these
bits. The bits in which two nodes' patterns differ under both masks differ for every pair below them, so a pair of nodes
is pruned with all its members as soon as the accumulated differences exceed what its members may differ by.
"""

from __future__ import annotations

import numpy as np

from recordloom.llm.text import ranges

FANOUT = 8
#: Pairs of nodes that are unfolded at once.
SLICE = 1 << 17
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(lanes: np.ndarray) -> np.ndarray:
    """Rank in the Gray code of words of several lanes, first lane first: each bit becomes the parity of the bits above
    it and itself."""
    rank = lanes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    for k in range(1, len(rank)):
        odd = (rank[k - 1] & np.uint64(1)).astype(bool)
        rank[k, odd] = ~rank[k, odd]
    return rank


class GrayIndex:
    """Levels of nodes over codes; two codes may differ in as many bits as their ``reach`` adds up to.

    ``tested`` and ``pruned`` count the pairs of nodes above the codes, ``spared`` the pairs of codes below pruned ones.
    """

    def __init__(self, lanes: np.ndarray, reach: np.ndarray):
        self.order = np.lexsort(gray_rank(lanes)[::-1])
        pattern, reach = lanes[:, self.order], reach[self.order]
        n = pattern.shape[1]
        mask, size = np.full_like(pattern, ONES), np.ones(n, np.int64)
        self.levels = [(pattern, mask, reach, np.arange(n), size, size)]
        while pattern.shape[1] > 1:
            head = np.arange(0, pattern.shape[1], FANOUT)
            children = np.diff(np.append(head, pattern.shape[1]))
            first = np.repeat(pattern[:, head], children, axis=1)
            mask = np.bitwise_and.reduceat(mask & ~(pattern ^ first), head, axis=1)
            pattern, reach = pattern[:, head], np.maximum.reduceat(reach, head)
            size = np.add.reduceat(size, head)
            self.levels.append((pattern, mask, reach, head, children, size))
        self.tested = self.pruned = self.spared = 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of codes within reach of each other, as positions in the input."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        top = len(self.levels) - 1
        roots = np.arange(self.levels[top][0].shape[1])
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > SLICE:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            pattern, mask, reach, head, children, size = self.levels[level]
            # The first lane leaves out most, so the others are looked at only where it agrees.
            keep = np.flatnonzero(((pattern[0, a] ^ pattern[0, b]) & mask[0, a] & mask[0, b]) == 0)
            x, y = a[keep], b[keep]
            differ = (pattern[1:, x] ^ pattern[1:, y]) & mask[1:, x] & mask[1:, y]
            keep = keep[np.bitwise_count(differ).sum(axis=0, dtype=np.int64) <= reach[x] + reach[y]]
            if level:
                gone = np.ones(len(a), bool)
                gone[keep] = False
                self.tested += len(a)
                self.pruned += int(gone.sum())
                self.spared += int((size[a[gone]] * size[b[gone]]).sum())
            a, b = a[keep], b[keep]
            if level == 0:
                apart = a != b
                out.append((self.order[a[apart]], self.order[b[apart]]))
                continue
            # Children of a with children of b, each pair once.
            left = ranges(head[a], children[a])
            pair = np.repeat(np.arange(len(a)), children[a])
            count = children[b][pair]
            right = ranges(head[b][pair], count)
            left = np.repeat(left, count)
            once = left < right if level == 1 else left <= right
            stack.append((level - 1, left[once], right[once]))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
