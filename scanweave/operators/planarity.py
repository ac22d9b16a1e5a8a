"""Planarity of clusters: normals from ten neighbours, then region growing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components, least_reached
from ..plans.tables import written
from .neighbours import near_rows
from .tiles import places

#: Points of a cell, if they lay in a plane.
PER_CELL = 64
NEIGHBOURS, SMOOTH, CURVATURE, LEAST_REGION, SHARE = 10, np.deg2rad(10.0), 1.2, 20, 0.2


def _k_least(xyz: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k nearest of `among` to each of `rows`, by distance and then by index; squared distance of the last)."""
    d = np.zeros((len(rows), len(among)))
    for axis in xyz.T:
        gap = axis[rows, None] - axis[among]
        d += gap * gap
    last = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, at = np.nonzero(d <= last[:, None])
    order = np.lexsort((at, d[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k  # more than k where distances are equal
    return among[at[first]].reshape(len(rows), k), last


def nearest(xyz: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Indices of the k nearest points of each point, itself included.

    Points look into the 27 cells around their own. A point whose k-th neighbour there lies within one cell's width has
    found them all; the others look again with cells twice as wide.
    """
    n, k = len(xyz), min(k, len(xyz))
    out, left = np.zeros((n, k), int), np.arange(n)
    low, extent = (xyz.min(0), float(np.ptp(xyz, axis=0).max())) if n else (np.zeros(3), 0.0)
    width = extent / max(1.0, np.sqrt(n / PER_CELL))
    while len(left):
        all_in = width <= 0 or width >= extent or n <= block
        cell = np.zeros((n, 3), np.int64) if all_in else np.floor((xyz - low) / width).astype(np.int64) + 1
        key = (cell[:, 0] << 42) + (cell[:, 1] << 21) + cell[:, 2]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        left = left[np.argsort(key[left], kind="stable")]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(key[left]) != 0, [True]]))
        again = []
        for i, j in zip(edges[:-1], edges[1:]):
            at = int(key[left[i]])
            # cells one above the other in z are neighbours in the order
            spans = [(at + (dx << 42) + (dy << 21) - 1, at + (dx << 42) + (dy << 21) + 2) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
            bounds = np.searchsorted(ordered, np.array(spans).ravel()).reshape(-1, 2)
            among = np.sort(np.concatenate([order[x:y] for x, y in bounds])) if not all_in else np.arange(n)
            for r in range(i, j, block):
                rows = left[r : min(j, r + block)]
                if len(among) < k:
                    again.append(rows)
                    continue
                near, last = _k_least(xyz, rows, among, k)
                found = np.full(len(rows), True) if all_in else last <= width * width
                out[rows[found]] = near[found]
                again.append(rows[~found])
        left = np.concatenate(again)
        width *= 2
    return out


def normals(xyz: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit normal, curvature) of each point from its neighbours."""
    near = xyz[around]
    centred = near - near.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred) / near.shape[1])
    total = values.sum(1)
    return vectors[:, :, 0], np.divide(np.abs(values[:, 0]), total, out=np.zeros(len(total)), where=total > 0)


def grown_points(xyz: np.ndarray) -> int:
    """Points in regions of at least LEAST_REGION points, grown from the flattest seeds over like normals."""
    if len(xyz) < LEAST_REGION:
        return 0
    around = nearest(xyz, NEIGHBOURS)
    normal, curvature = normals(xyz, around)
    free, total = [True] * len(xyz), 0
    # edges to neighbours with a like normal, found at once; what is left to do in order is to walk along them
    like = np.abs(np.einsum("nki,ni->nk", normal[around], normal)) >= np.cos(SMOOTH)
    ahead, ends = around[like].tolist(), np.cumsum(np.concatenate([[0], like.sum(1)])).tolist()
    grows = (curvature < CURVATURE).tolist()
    for seed in np.argsort(curvature, kind="stable").tolist():
        if not free[seed]:
            continue
        free[seed] = False
        queue, size = [seed], 1
        while queue:
            p = queue.pop()
            for q in ahead[ends[p] : ends[p + 1]]:
                if free[q]:
                    free[q] = False
                    size += 1
                    # points too curved to seed further growth belong to the region all the same
                    if grows[q]:
                        queue.append(q)
        if size >= LEAST_REGION:
            total += size
    return total


def _sames(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(least of the n nodes that each is joined with by edges in both directions, which edges lead to another such group)."""
    both = np.isin(a * n + b, b * n + a)
    root = np.arange(n)
    nodes, least = least_reached(a[both], b[both])
    root[nodes] = least
    return root, root[a] != root[b]


def _links(tile: pa.Table, who: np.ndarray, near: np.ndarray, far: np.ndarray) -> list:
    """Normals of a tile's settled points, and what region growing does among them; neighbours elsewhere are left open."""
    ids, xyz = tile.column("id").to_numpy(), places(tile)
    parts = [normals(xyz, near[i : i + (1 << 16)]) for i in range(0, len(near), 1 << 16)]
    normal, curvature = (np.concatenate(p) for p in zip(*parts))
    by_id = np.argsort(ids[who])
    own, n = ids[who][by_id], len(who)
    near, normal, curvature = ids[near[by_id]], normal[by_id], curvature[by_id]
    at = np.minimum(np.searchsorted(own, near), n - 1)
    here = own[at] == near
    a, k = np.nonzero(here)
    b = at[a, k]
    like = np.abs(np.einsum("ij,ij->i", normal[b], normal[a])) >= np.cos(SMOOTH)
    a, b = a[like & (a != b)], b[like & (a != b)]
    root, one_way = _sames(a, b, n)
    ahead = np.unique(np.stack([root[a[one_way]], root[b[one_way]]]), axis=1)
    # the flattest seed that leads to each group
    order = np.lexsort((own, curvature))
    seed = np.empty(n, np.int64)
    seed[order] = np.arange(n)
    np.minimum.at(seed, root, seed.copy())
    while True:
        before = seed.copy()
        np.minimum.at(seed, ahead[1], seed[ahead[0]])
        if np.array_equal(before, seed):
            break
    first = order[seed[root]]
    back = np.argsort(by_id)  # rows come in the order of `who`
    ends = np.searchsorted(ahead[0], np.arange(n + 1))
    aheads = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own[ahead[1]])).take(pa.array(back))
    opens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((~here).sum(1))]), pa.int32()), pa.array(near[~here])).take(pa.array(back))
    plain = [*normal.T, own[root], np.bincount(root, minlength=n), curvature[first], own[first]]
    return [*(tile.column(c).take(pa.array(who)) for c in _POINT), *(pa.array(np.ascontiguousarray(v[back])) for v in plain), aheads, opens]


_POINT = ["frame_id", "cluster_id", "x", "y", "z", "id"]
_MADE = "nx double, ny double, nz double, root long, size long, seed_c double, seed long, ahead array<long>, open array<long>"


def planarity(clustered: DataFrame) -> DataFrame:
    """(frame_id, cluster_id, n_pts, grown, planar) for clusters of points with x, y, z.

    The same regions as grown_points() finds, without a cluster in one task. All curvatures are below CURVATURE, a third at most, so
    each point belongs to the region of the first seed, by curvature and then by place, from which edges to like neighbours lead to it.
    Tiles of space find neighbours, normals and edges, and the first seed within the tile; points joined in both directions are one
    group from then on. Edges between tiles join with their ends; groups that such edges join in both directions become one by
    components, and what remains are rounds that hand seeds on along edges of one direction, from groups whose seed changed only.
    """
    ordered = clustered.select(F.col("frame_id").cast("int").alias("frame_id"), F.col("cluster_id").cast("long").alias("cluster_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    order = ["frame_id", "cluster_id", "x", "y", "z"]
    placed = written(ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "places")
    found = near_rows(placed.select(*_POINT), NEIGHBOURS, ["frame_id", "cluster_id"], ["id"], _links, _MADE, "root", whole=True)
    # a group lies in one tile; the row of the point that names it has its size
    roots = found.where("id = root").select("root", "frame_id", "cluster_id", "size", F.struct("seed_c", "seed").alias("seed"))
    there = found.select(F.col("id").alias("b"), F.col("root").alias("to"), *(F.col(f"n{c}").alias(f"m{c}") for c in "xyz"))
    open_ = found.where(F.size("open") > 0).select(F.col("id").alias("a"), F.col("root").alias("group"), "nx", "ny", "nz", F.explode("open").alias("b"))
    turn = F.abs(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))
    cross = written(open_.join(there, "b").where(turn >= float(np.cos(SMOOTH))).select("a", "group", "b", "to"), "crossing")
    if cross.limit(1).count():
        roots = _joined(found, roots, cross)
    sizes = roots.groupBy("frame_id", "cluster_id", "seed").agg(F.sum("size").alias("size"))
    each = sizes.groupBy("frame_id", "cluster_id").agg(F.sum("size").alias("n_pts"), F.sum(F.when(F.col("size") >= LEAST_REGION, F.col("size")).otherwise(0)).alias("grown"))
    return each.withColumn("planar", F.col("grown") >= SHARE * F.col("n_pts"))


def _joined(found: DataFrame, roots: DataFrame, cross: DataFrame) -> DataFrame:
    """roots with the first seed over all tiles; groups that edges between tiles join in both directions are one row."""
    pair = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    pairs = cross.groupBy(*pair).agg(F.count("*").alias("n"), F.first("group").alias("group"), F.first("to").alias("to"))
    merged = connected_components(pairs.where("n = 2").select(F.col("group").alias("a"), F.col("to").alias("b")))
    whole = lambda df, c: df.join(merged.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    joined = roots.join(merged.select(F.col("node").alias("root"), "component"), "root").groupBy(F.col("component").alias("root"))
    several = joined.agg(F.first("frame_id").alias("frame_id"), F.first("cluster_id").alias("cluster_id"), F.sum("size").alias("size"), F.min("seed").alias("seed"))
    groups = written(roots.join(merged.select(F.col("node").alias("root")), "root", "left_anti").unionByName(several), "groups")
    crossing = pairs.where("n = 1").select("group", "to")
    ahead = found.where(F.size("ahead") > 0).select(F.col("root").alias("group"), F.explode("ahead").alias("to"))
    edges = written(whole(whole(ahead.unionByName(crossing), "group"), "to").where("group <> to").distinct(), "ahead")
    changed = written(groups.join(whole(cross.select(F.col("group").alias("root")).distinct(), "root").distinct(), "root", "left_semi").select("root", "seed"), "seeds")
    best = changed
    while changed.limit(1).count():
        sent = edges.join(changed, edges["group"] == changed["root"]).groupBy(F.col("to").alias("root")).agg(F.min("seed").alias("sent"))
        now = groups.select("root", "seed").join(sent, "root").join(best.withColumnRenamed("seed", "best"), "root", "left")
        changed = written(now.where(F.col("sent") < F.coalesce("best", "seed")).select("root", F.col("sent").alias("seed")), "seeds")
        best = written(best.unionByName(changed).groupBy("root").agg(F.min("seed").alias("seed")), "best")
    return groups.join(best.withColumnRenamed("seed", "best"), "root", "left").withColumn("seed", F.coalesce("best", "seed")).drop("best")
