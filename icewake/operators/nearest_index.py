"""Nearest of many places on a plane: boxes over runs of neighbouring places, in levels, searched for many points at once.

Of the boxes left to a point, those that begin farther off than some other box ends are dropped, level by level, so a point meets
a few boxes a level.  All distances are squared, in double precision.
"""

from __future__ import annotations

import numpy as np

FAN = 8  # boxes in a box of the level above
PAIRS = 1 << 19  # points with boxes that are held at once
SLACK = 1 + 1e-12


def along_curve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of places along a curve of ever smaller quarters, so that neighbours in it are near."""
    key = np.zeros(len(a), dtype=np.uint64)
    for c, shift in ((a, 0), (b, 1)):
        low, high = float(c.min()) / 2, float(c.max()) / 2
        fine = np.minimum(((c / 2 - low) / ((high - low) or 1.0) * 65536).astype(np.uint64), np.uint64(65535))
        for bit in range(16):
            key |= ((fine >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit + shift)
    return np.argsort(key, kind="stable")


def boxes(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Least and greatest a and b of every ``size`` places, as four rows."""
    starts = np.arange(0, len(a), size)
    return np.stack([np.minimum.reduceat(a, starts), np.maximum.reduceat(a, starts), np.minimum.reduceat(b, starts), np.maximum.reduceat(b, starts)])


class Boxes:
    """Levels of boxes over boxes; ``possible`` names those of the lowest level that may hold what is nearest to a point."""

    def __init__(self, lowest: np.ndarray):
        self.levels = [lowest]
        while self.levels[0].shape[1] > FAN:
            low = self.levels[0]
            starts = np.arange(0, low.shape[1], FAN)
            self.levels.insert(0, np.stack([f.reduceat(row, starts) for f, row in zip((np.minimum, np.maximum) * 2, low, strict=True)]))

    def possible(self, lat: np.ndarray, lon: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of a point and a box, ordered by point, at least one for each; None if they are too many to hold.

        ``bound`` is the squared distance of some place, where one is known.
        """
        point, node = np.arange(len(lat)), np.zeros(len(lat), dtype=np.int64)
        bound = np.full(len(lat), np.inf) if bound is None else bound
        for level in self.levels:
            if len(point) * FAN > PAIRS and len(lat) > 1:
                return None
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            point = np.repeat(point, FAN)
            real = node < level.shape[1]
            node, point = node[real], point[real]
            x, y = lat[point], lon[point]
            a0, a1, b0, b1 = level[:, node]
            with np.errstate(over="ignore"):
                da, db = np.maximum(np.maximum(a0 - x, x - a1), 0.0), np.maximum(np.maximum(b0 - y, y - b1), 0.0)
                ea, eb = np.maximum(np.abs(a0 - x), np.abs(a1 - x)), np.maximum(np.abs(b0 - y), np.abs(b1 - y))
                least, most = da * da + db * db, ea * ea + eb * eb
            first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
            bound = np.minimum(bound, np.minimum.reduceat(most, first))
            left = least <= bound[point] * SLACK
            node, point = node[left], point[left]
        return point, node


class Places:
    """Places with ranks; ``nearest`` gives the number of the nearest, the lowest rank on a tie, and the squared distance."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, rank: np.ndarray, leaf: int):
        self.order = along_curve(lat, lon)
        self.lat, self.lon, self.rank = lat[self.order], lon[self.order], rank[self.order]
        self.by_rank = np.empty(len(rank), dtype=np.int64)
        self.by_rank[rank] = np.arange(len(rank))
        self.leaf, self.tree = leaf, Boxes(boxes(self.lat, self.lon, leaf))  # places in the smallest boxes

    def nearest(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(lat):
            return np.empty(0, dtype=np.int64), np.empty(0)
        met = self.tree.possible(lat, lon)
        if met is None or (len(met[0]) * self.leaf > PAIRS * 4 and len(lat) > 1):
            half = len(lat) // 2
            return tuple(np.concatenate(x) for x in zip(self.nearest(lat[:half], lon[:half]), self.nearest(lat[half:], lon[half:]), strict=True))
        point, leaf = met
        at = leaf[:, None] * self.leaf + np.arange(self.leaf)
        real = at < len(self.lat)
        at = np.minimum(at, len(self.lat) - 1)  # the last place again, which changes no least distance
        with np.errstate(over="ignore"):
            x, y = self.lat[at] - lat[point, None], self.lon[at] - lon[point, None]
            d2 = x * x + y * y
        first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        best = np.minimum.reduceat(d2.min(axis=1), first)
        rank = np.where(real & (d2 == best[point, None]), self.rank[at], len(self.lat)).min(axis=1)
        return self.by_rank[np.minimum.reduceat(rank, first)], best
