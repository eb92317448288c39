"""Signature trees over sets of 64-bit hashes, joined by dual traversal.

A node holds the OR of its sets' bitmaps, the range of their sizes and the most members that share one bit in any of its
sets. Leaves come by size band and, inside a band, by two least hashes, so that similar sets are neighbours and the bitmaps
of their nodes stay sparse. Two sets can overlap by no more than the smaller size, and by no more than the bits that both bitmaps have times
the members per bit; a pair of nodes is pruned if that is less than the overlap that its smallest sizes ask for.
"""

from __future__ import annotations

import math

import numpy as np

BITS = 4096
FANOUT = 4
#: Sizes whose logarithms fall into the same step of this ratio are a band.
BAND = 4 / 3
#: Pairs looked at together, which bounds the memory for their bitmaps.
CHUNK = 65_536


_LEAST = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Level:
    def __init__(self, bitmaps, least, most, shared):
        self.bitmaps, self.least, self.most, self.shared = bitmaps, least, most, shared

    def above(self) -> Level:
        at = np.arange(0, len(self.least), FANOUT)
        return Level(
            np.bitwise_or.reduceat(self.bitmaps, at, axis=0), np.minimum.reduceat(self.least, at), np.maximum.reduceat(self.most, at), np.maximum.reduceat(self.shared, at)
        )


def bitmap(members: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's bitmap and the most members on one bit."""
    counts = np.bincount((members >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS)
    return np.packbits(counts > 0).view(np.uint64), int(counts.max())


class Forest:
    """Union-find; the least index is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            while self.root[a] != a:
                a = self.root[a]
            while self.root[b] != b:
                b = self.root[b]
            if a != b:
                self.root[max(a, b)] = min(a, b)
        self.settle()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class Tree:
    def __init__(self, sets: list[np.ndarray], numerator: int, denominator: int):
        """``sets``: sorted, not empty. Two link if intersection / union >= numerator / denominator."""
        self.p, self.q = numerator, denominator
        band = [int(math.log(len(s)) / math.log(BAND)) for s in sets]
        least = [[int((s * m).min()) for s in sets] for m in _LEAST]
        self.order = np.lexsort((least[1], least[0], band)) if len(sets) > 2 else np.arange(len(sets))
        #: Pairs of leaves there are, pairs that the traversal comes to, and pairs whose sets are compared.
        self.n_pairs, self.n_met, self.n_compared = len(sets) * (len(sets) - 1) // 2, 0, 0
        self.sets = [sets[i] for i in self.order]
        n = np.array([len(s) for s in self.sets], dtype=np.int64)
        marks = [bitmap(s) for s in self.sets]
        self.levels = [Level(np.stack([m[0] for m in marks]), n, n, np.array([m[1] for m in marks], dtype=np.int64))]
        while len(self.levels[-1].least) > 1:
            self.levels.append(self.levels[-1].above())

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, leaf = self.levels[level], level == 0
        near = (self.q * x.most[i] >= self.p * x.least[j]) & (self.q * x.most[j] >= self.p * x.least[i])
        both = np.bitwise_count(x.bitmaps[i] & x.bitmaps[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(x.most[i], x.most[j]), both * np.minimum(x.shared[i], x.shared[j]))
        if leaf:  # every bit that the other lacks is a member that the other lacks
            bits_i, bits_j = (np.bitwise_count(x.bitmaps[k]).sum(axis=1, dtype=np.int64) for k in (i, j))
            most = np.minimum(most, np.minimum(x.most[i] - (bits_i - both), x.most[j] - (bits_j - both)))
        # overlap / (sizes - overlap) >= p / q
        return near & ((self.p + self.q) * most >= self.p * (x.least[i] + x.least[j]))

    def _children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, f = len(self.levels[level - 1].least), np.arange(FANOUT)
        a = (i[:, None] * FANOUT + f)[:, :, None]
        b = (j[:, None] * FANOUT + f)[:, None, :]
        a, b = np.broadcast_arrays(a, b)
        ok = (a < n) & (b < n) & (a < b if level == 1 else a <= b)
        return a[ok], b[ok]

    def pairs(self):
        """Pairs of places that may link, in chunks; depth first, so few pairs wait at a time."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))] if top else []
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                self.n_met += len(i)
                yield i, j
                continue
            if len(i) > CHUNK // FANOUT**2:
                half = max(1, len(i) // 2)
                stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            i, j = self._children(level, i, j)
            if level > 1:
                ok = self._possible(level - 1, i, j)
                i, j = i[ok], j[ok]
            if len(i):
                stack.append((level - 1, i, j))

    def linked(self, groups: np.ndarray | None = None) -> np.ndarray:
        """For each set the least index of a set that it reaches by links. ``groups``: sets with equal values count as linked
        from the start. Pairs that are connected already are not compared; all others that may link are."""
        forest = Forest(len(self.sets))
        if groups is not None:
            _, first, of = np.unique(groups[self.order], return_index=True, return_inverse=True)
            forest.root = first[of]
        for i, j in self.pairs():
            root = forest.settle()
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            if len(i):
                ok = self._possible(0, i, j)
                i, j = i[ok], j[ok]
            while len(i):
                # One partner for each set at a time; what that connects spares the other pairs.
                _, at = np.unique(j, return_index=True)
                self.n_compared += len(at)
                hit = np.array([self._links(a, b) for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True)])
                forest.union(i[at][hit], j[at][hit])
                rest = np.ones(len(i), dtype=bool)
                rest[at] = False
                root = forest.settle()
                rest &= root[i] != root[j]
                i, j = i[rest], j[rest]
        root = forest.settle()
        out = np.empty(len(root), dtype=np.int64)
        out[self.order] = root
        least = np.full(len(root), len(root), dtype=np.int64)
        np.minimum.at(least, out, np.arange(len(root)))
        return least[out]

    def _links(self, a: int, b: int) -> bool:
        x = overlap(self.sets[a], self.sets[b])
        return self.q * x >= self.p * (len(self.sets[a]) + len(self.sets[b]) - x)
