"""The Gray-order hierarchical index of operator 6 over fingerprints of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DISTANCE = 3
#: Children of an index node.
FANOUT = 8
#: Query and node pairs that are held at once.
FRONTIER = 1_000_000


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set; 0 for none."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Index:
    """Levels of nodes over fingerprints of many groups, sorted by group and Gray rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.group, self.fp = order, group[order], fp[order]
        start = np.flatnonzero(np.diff(self.group, prepend=self.group[:1] - 1))
        self.levels = [(self.fp, np.full(len(fp), ~np.uint64(0)), np.arange(len(fp)), np.arange(1, len(fp) + 1))]  # pattern, mask, entries below: first and end
        above = []
        while True:
            pattern, mask, first, end = self.levels[-1]
            sizes = np.diff(np.append(start, len(pattern)))
            if len(above) and sizes.max(initial=1) <= 1:
                break
            rank = np.arange(len(pattern)) - np.repeat(start, sizes)
            child = np.flatnonzero(rank % FANOUT == 0)  # first child of each new node
            every, some = np.bitwise_and.reduceat(pattern | ~mask, child), np.bitwise_or.reduceat(pattern & mask, child)
            shared = ~(every ^ some) & np.bitwise_and.reduceat(mask, child)
            last = np.append(child[1:], len(pattern))
            above.append((child, last))
            self.levels.append((every & shared, shared, first[child], end[last - 1]))
            start = np.searchsorted(child, start)
        self.above = above
        for k in range(len(self.levels) - 1):  # what the parent has factored out counts there
            pattern, mask, first, end = self.levels[k]
            parent = np.repeat(np.arange(len(above[k][0])), above[k][1] - above[k][0])
            self.levels[k] = (pattern, mask & ~self.levels[k + 1][1][parent], first, end)
        self.root = np.repeat(np.arange(len(self.levels[-1][0])), self.levels[-1][3] - self.levels[-1][2])

    def pairs(self, limit: int = DISTANCE, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked entries i < j, in blocks."""
        size = (self.levels[-1][3] - self.levels[-1][2])[self.root]
        block = np.cumsum(size) // frontier
        for q in np.split(np.arange(len(self.fp)), np.flatnonzero(np.diff(block)) + 1):
            node, seen = self.root[q], np.zeros(len(q), np.uint8)
            for k in range(len(self.levels) - 2, -1, -1):
                first, last = self.above[k][0][node], self.above[k][1][node]
                n = last - first
                q, seen = np.repeat(q, n), np.repeat(seen, n)
                node = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                pattern, mask, _, end = self.levels[k]
                seen = seen + np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node])
                keep = (seen <= limit) & (end[node] > q + 1)
                q, node, seen = q[keep], node[keep], seen[keep]
            yield q, node
