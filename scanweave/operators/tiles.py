"""Tiles of space that meet in one task each, and the search for near points inside one by grids of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
TILE = ("__x", "__y", "__z")
#: Points of the fullest tile where tiles can be cut so small, and candidates that a task measures at a time.
FULL, BLOCK = 1 << 17, 1 << 18
#: Widths that are counted for one of the finest.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Cells see this share of their width around each point for sure, whatever rounding does to their borders.
SURE = 0.999


def finite() -> Column:
    """Whether a row has a place."""
    bound = F.lit(float("inf"))
    return (F.abs("x") < bound) & (F.abs("y") < bound) & (F.abs("z") < bound)


def tile_index(c: str, width: float, by: Column | float = 0.0) -> Column:
    return F.floor((F.col(c) + by) / width).cast("long")


def extent_of(points: DataFrame) -> float:
    seen = points.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in AXES)).first()
    return max((seen[f"high_{c}"] - seen[f"low_{c}"] for c in AXES), default=0.0) if seen["low_x"] is not None else 0.0


def tile_width(points: DataFrame, on: list[str], extent: float, least: float = 0.0) -> float:
    """The widest tiles of which none holds more than FULL points; not below `least`. Counted for all STEPS in one pass."""
    if not extent > 0:
        return max(least, 1.0)
    finest = max(least, extent / 64)
    for _ in range(8):
        cells = points.groupBy(*on, *(tile_index(c, finest).alias(t) for c, t in zip(AXES, TILE))).count()
        levels = cells.withColumn("level", F.explode(F.array(*map(F.lit, STEPS))))
        wider = levels.groupBy(*on, "level", *(F.floor(F.col(t) / F.col("level")).alias(t) for t in TILE)).agg(F.sum("count").alias("n"))
        most = {r["level"]: r["n"] for r in wider.groupBy("level").agg(F.max("n").alias("n")).collect()}
        fit = [j for j, n in most.items() if n <= FULL]
        if fit or finest <= least:
            return finest * max(fit, default=1)
        finest = max(least, finest / 64)
    return finest


def with_halo(points: DataFrame, width: float, reach: Column | float) -> DataFrame:
    """A row for each tile that a point lies in or within reach of; a reach for each, or one for all."""
    for c, t in zip(AXES, TILE):
        points = points.withColumn(t, F.explode(F.sequence(tile_index(c, width, -reach), tile_index(c, width, reach))))
    return points


def places(table: pa.Table) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in AXES])


def in_order(table: pa.Table, columns: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in columns], null_placement="at_start")) if columns else table


class Cells:
    """Points sorted by cells; cells one above the other in z lie together, so nine spans hold the 27 around a place."""

    def __init__(self, xyz: np.ndarray, width: float):
        self.xyz, self.low, self.width = xyz, xyz.min(0), max(width, float(np.ptp(xyz, axis=0).max()) / (1 << 19))
        cell = np.floor((xyz - self.low) / self.width).astype(np.int64) + 1
        self.most = cell.max(0)
        self.sizes = self.most + 3
        key = self._key(cell)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.sorted = key[self.order], np.ascontiguousarray(xyz[self.order].T)

    def _key(self, cell: np.ndarray) -> np.ndarray:
        return (cell[:, 0] * self.sizes[1] + cell[:, 1]) * self.sizes[2] + cell[:, 2]

    def crowd(self) -> float:
        """Points of an occupied cell, on average."""
        return len(self.keys) / (1 + np.count_nonzero(self.keys[1:] != self.keys[:-1]))

    def blocks(self, asked: np.ndarray):
        """(which of `asked`, first candidate of each, candidates one after the other, their squared distances), in blocks of
        at most BLOCK candidates or one place, none with more than twice as many as another and 16. All points within `width` are candidates, and some beyond."""
        # what lies outside looks from the border: that gives more candidates, not fewer
        cell = np.clip(np.floor((asked - self.low) / self.width).astype(np.int64) + 1, 0, self.most + 1)
        key = self._key(cell)
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        spans = [(dx * self.sizes[1] + dy) * self.sizes[2] for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        first = np.column_stack([np.searchsorted(self.keys, key + s - 1) for s in spans])
        count = np.column_stack([np.searchsorted(self.keys, key + s + 2) for s in spans]) - first
        # places with like numbers of candidates go together, so that a block can be a matrix
        size = count.sum(1)
        by_size = np.argsort(size, kind="stable")
        size, first, count, by_key = size[by_size], first[by_size], count[by_size], by_key[by_size]
        ends = np.cumsum(size)
        i = 0
        while i < len(key):
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right"))
            j = max(i + 1, min(j, i + BLOCK // 8, int(np.searchsorted(size, 2 * size[i] + 16, "right"))))
            n, at, own = count[i:j].ravel(), first[i:j].ravel(), by_key[i:j]
            before = np.cumsum(n) - n
            flat = np.repeat(at - before, n)
            flat += np.arange(len(flat))
            d = np.zeros(len(flat))
            for c in (0, 1, 2):
                gap = np.repeat(asked[own, c], size[i:j])
                gap -= self.sorted[c][flat]
                gap *= gap
                d += gap
            yield own, before[::9], self.order[flat], d
            i = j


def _ladder(xyz: np.ndarray, reach: float, crowd: float) -> list[float]:
    """Widths from one whose cells hold `crowd` points on average, or hardly more, up to the reach, each twice the one before."""
    widths = [reach]
    while len(widths) < 24 and Cells(xyz, widths[-1]).crowd() > 2 * crowd:
        widths.append(widths[-1] / 2)
    return widths[::-1]


def nearest_of(asked: np.ndarray, xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest of xyz to each place, the first of several, -1 where none is within the radius; its squared distance)."""
    out, far = np.full(len(asked), -1), np.full(len(asked), np.inf)
    if not len(xyz) or not len(asked):
        return out, far
    left = np.flatnonzero(np.isfinite(asked).all(1))
    widths = _ladder(xyz, radius / SURE, 1.0)
    for width in widths:
        cells, again = Cells(xyz, width), []
        for which, start, flat, d in cells.blocks(asked[left]):
            some = np.diff(np.append(start, len(flat))) > 0
            again.append(left[which[~some]])
            who, start = left[which[some]], start[some]
            if not len(who):
                continue
            least = np.minimum.reduceat(d, start)
            tied = d == np.repeat(least, np.diff(np.append(start, len(d))))
            best = np.minimum.reduceat(np.where(tied, flat, len(xyz)), start)
            done = least <= (SURE * width) ** 2 if width is not widths[-1] else least <= radius * radius
            out[who[done]], far[who[done]] = best[done], least[done]
            again.append(who[~done])
        left = np.concatenate(again) if again else left[:0]
        if not len(left):
            break
    return out, far


def k_nearest_of(asked: np.ndarray, xyz: np.ndarray, k: int, reach: float, everything: bool):
    """(which places, indices of the k nearest of xyz by distance and then by index, squared distances) in parts, for places
    whose k-th neighbour lies within the reach, or for all; with fewer than k points, all of them."""
    if len(xyz) < k and not everything:
        return
    k, left = min(k, len(xyz)), np.arange(len(asked))
    if not k or not len(left):
        return
    widths = _ladder(xyz, reach / SURE, k / 4)
    for width in widths:
        cells, again = Cells(xyz, width), []
        last_round = everything and width is widths[-1]
        for which, start, flat, d in cells.blocks(asked[left]):
            size = np.diff(np.append(start, len(flat)))
            enough = size >= k
            again.append(left[which[~enough]])
            if not enough.any():
                continue
            wide = np.full((len(size), max(int(size.max()), k)), np.inf)
            wide[np.arange(wide.shape[1]) < size[:, None]] = d
            near = np.argpartition(wide, k - 1, axis=1)[:, :k]
            far = np.take_along_axis(wide, near, 1)
            last = far.max(1)
            done = enough & ((last <= (SURE * width) ** 2) | last_round)
            again.append(left[which[enough & ~done]])
            if not done.all():
                which, start, wide, near, far, last = (v[done] for v in (which, start, wide, near, far, last))
            at = flat[start[:, None] + near]
            tied = np.flatnonzero(np.count_nonzero(wide <= last[:, None], axis=1) > k)  # more than k where distances are equal
            if len(tied):
                row, column = np.nonzero(wide[tied] <= last[tied, None])
                among, gap = flat[start[tied][row] + column], wide[tied[row], column]
                order = np.lexsort((among, gap, row))
                first = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                at[tied], far[tied] = among[first].reshape(-1, k), gap[first].reshape(-1, k)
            order = np.lexsort((at, far), axis=1)
            yield left[which], np.take_along_axis(at, order, 1), np.take_along_axis(far, order, 1)
        left = np.concatenate(again)
        if not len(left):
            return


def few_nearest_of(asked: np.ndarray, xyz: np.ndarray, k: int, reach: np.ndarray):
    """(which places, indices of xyz, squared distances) in parts, a row for each of the k nearest of xyz within the place's reach,
    or of all there are, by distance and then by index."""
    left, widths = np.arange(len(asked)), _ladder(xyz, float(reach.max()) / SURE, k / 4)
    for width in widths:
        cells, again = Cells(xyz, width), []
        for which, start, flat, d in cells.blocks(asked[left]):
            row = np.repeat(np.arange(len(which)), np.diff(np.append(start, len(flat))))
            own = reach[left[which]]
            all_seen = (own <= SURE * width) | (width is widths[-1])
            keep = d <= (np.where(all_seen, own, SURE * width) ** 2)[row]
            row, at, far = row[keep], flat[keep], d[keep]
            order = np.lexsort((at, far, row))
            row, at, far = row[order], at[order], far[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            done = (np.bincount(row, minlength=len(which)) >= k) | all_seen
            keep = first & done[row]
            again.append(left[which[~done]])
            yield left[which[row[keep]]], at[keep], far[keep]
        left = np.concatenate(again)
        if not len(left):
            return
