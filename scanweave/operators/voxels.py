"""Polar voxels: window, bins, keys, statistics, neighbours, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..config import Settings
from ..functions.geometry import computed, elevation, planar_range, polar_angle
from ..plans.components import connected_components

#: Node numbers of different frames lie apart by more than any grid's voxels; keys of lower-bound values may be negative.
FRAME, LEAST_KEY = 1 << 32, -(1 << 20)


def with_geometry(points: DataFrame) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return computed(points, {"rng": planar_range(x, y), "ang": polar_angle(x, y), "azi": elevation(x, y, z)})


def in_window(s: Settings) -> Column:
    return F.col("rng").between(s.min_dis, s.max_dis) & F.col("ang").between(s.min_angle, s.max_angle) & F.col("azi").between(s.min_azimuth, s.max_azimuth)


def with_bins(geometry: DataFrame, s: Settings) -> DataFrame:
    """Adds r_i, s_i, a_i and the voxel key. A value at a lower bound has index -1, and its key falls to a neighbour."""
    index = lambda c, low, res: (F.ceil((F.col(c) - low) / res) - 1).cast("long")
    out = geometry.withColumns({"r_i": index("rng", s.min_dis, s.range_res), "s_i": index("ang", s.min_angle, s.sector_res), "a_i": index("azi", s.min_azimuth, s.azimuth_res)})
    return out.withColumn("voxel", voxel_key(F.col("r_i"), F.col("s_i"), F.col("a_i"), s))


def voxel_key(r_i: Column, s_i: Column, a_i: Column, s: Settings) -> Column:
    return a_i * (s.range_num * s.sector_num) + r_i * s.sector_num + s_i


def binned(points: DataFrame, s: Settings) -> DataFrame:
    return with_bins(with_geometry(points).where(in_window(s)), s)


def bin_keys(xyz: np.ndarray, s: Settings) -> np.ndarray:
    """The voxel keys that binned() gives rows of (x, y, z), those outside the window left out: for kernels."""
    x, y, z = xyz.T
    rng = np.sqrt(x * x + y * y)
    turned = np.arctan2(y, x)
    ang = np.where((x == 0) & (y == 0), 0.0, np.where(y >= 0, turned, turned + 2 * np.pi) * 180.0 / np.pi)
    azi = np.arctan2(z, rng) * 180.0 / np.pi
    window = ((rng, s.min_dis, s.max_dis, s.range_res), (ang, s.min_angle, s.max_angle, s.sector_res), (azi, s.min_azimuth, s.max_azimuth, s.azimuth_res))
    inside = np.logical_and.reduce([(v >= low) & (v <= high) for v, low, high, _ in window])
    r_i, s_i, a_i = (np.ceil((v[inside] - low) / res).astype(np.int64) - 1 for v, low, _, res in window)
    return a_i * (s.range_num * s.sector_num) + r_i * s.sector_num + s_i


def voxel_stats(bins: DataFrame) -> DataFrame:
    """One row per occupied voxel: indices, points, mean and population variance of the intensity.

    The variance of whole numbers comes from their exact sums, so that it does not depend on the order of the rows.
    """
    spread = F.var_pop("refl")
    if isinstance(bins.schema["refl"].dataType, IntegralType):
        n, wide = F.count("refl"), lambda c: c.cast("decimal(19,0)")
        exact = wide(n) * wide(F.sum(F.col("refl") * F.col("refl"))) - wide(F.sum("refl")) * wide(F.sum("refl"))
        spread = F.when(n > 0, exact.cast("double") / (wide(n) * wide(n)).cast("double"))
    return bins.groupBy("frame_id", "voxel").agg(F.min("r_i").alias("r_i"), F.min("s_i").alias("s_i"), F.min("a_i").alias("a_i"), F.count("*").alias("n"), F.avg("refl").alias("i_mean"), spread.alias("i_var"))


def with_corner(voxels: DataFrame, s: Settings) -> DataFrame:
    """Adds the voxel's lower corner in metres."""
    rng = F.col("r_i") * s.range_res + s.min_dis
    ang = F.radians(F.col("s_i") * s.sector_res + s.min_angle)
    azi = F.radians(F.col("a_i") * s.azimuth_res + s.min_azimuth)
    return voxels.withColumns({"cx": rng * F.cos(ang), "cy": rng * F.sin(ang), "cz": rng * F.tan(azi)})


def downsample(points: DataFrame, leaf: float) -> DataFrame:
    """Centroids of a cubic grid; labels by majority, the least of the commonest."""
    cell = points.withColumns({c: F.floor(F.col(v) / leaf) for c, v in (("gx", "x"), ("gy", "y"), ("gz", "z"))})
    keys = ["frame_id", "gx", "gy", "gz"]
    by_label = cell.groupBy(*keys, "sem").agg(F.count("*").alias("k"), *(F.sum(c).alias(c) for c in ("x", "y", "z", "refl")))
    whole = by_label.groupBy(*keys).agg(F.sum("k").alias("n"), *(F.sum(c).alias(c) for c in ("x", "y", "z", "refl")), F.min_by("sem", F.struct(-F.col("k"), "sem")).alias("sem"))
    return whole.select(*keys, "n", "sem", *((F.col(c) / F.col("n")).alias(c) for c in ("x", "y", "z", "refl")))


def neighbour_edges(voxels: DataFrame, s: Settings, reach: int = 1, columns: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, u, v, columns of u and v): occupied voxels within `reach` index steps, by an equi-join on the key.

    Every in-bounds neighbour triple is turned into a key and looked up. Far voxels look one step around only.
    """
    far = F.col("r_i") > 0.6 * s.range_num
    size = F.when(far, 1).otherwise(reach)
    steps = lambda: F.sequence(-size, size)
    around = voxels.select("frame_id", F.col("voxel").alias("u"), *(F.col(c).alias(f"u_{c}") for c in columns), "r_i", "s_i", "a_i", steps().alias("ds"))
    around = around.withColumn("dr", F.explode("ds")).withColumn("dt", F.explode("ds")).withColumn("da", F.explode("ds"))
    x, y, z = F.col("r_i") + F.col("dr"), F.col("s_i") + F.col("dt"), F.col("a_i") + F.col("da")
    if s.wrap_sectors:
        y = F.pmod(y, F.lit(s.sector_num))
    inside = x.between(0, s.range_num - 1) & y.between(0, s.sector_num - 1) & z.between(0, s.azimuth_num - 1)
    keyed = around.where(inside).select("frame_id", "u", *(f"u_{c}" for c in columns), voxel_key(x, y, z, s).alias("v"))
    return keyed.join(voxels.select("frame_id", F.col("voxel").alias("v"), *(F.col(c).alias(f"v_{c}") for c in columns)), ["frame_id", "v"])


def joined_voxels(voxels: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, u, v): every neighbouring pair at least once, whichever way; half the look-ups of neighbour_edges().

    Voxels look ahead only, at 13 of 26 neighbours. One that holds a lower-bound value stands at another voxel's key: it
    looks all around from its own indices, and all around its key, where voxels without such values look for it.
    """
    odd = (F.col("r_i") < 0) | (F.col("s_i") < 0) | (F.col("a_i") < 0)
    key, plane = F.col("voxel"), s.range_num * s.sector_num
    at_key = {"a_i": F.floor(key / plane), "r_i": F.floor(F.pmod(key, F.lit(plane)) / s.sector_num), "s_i": F.pmod(key, F.lit(s.sector_num))}
    columns = ["frame_id", "voxel", "r_i", "s_i", "a_i"]
    looking = voxels.select(*columns, odd.alias("all"), F.lit(False).alias("by_key")).unionByName(voxels.where(odd & key.between(0, plane * s.azimuth_num - 1)).select("frame_id", "voxel", *(at_key[c].cast("long").alias(c) for c in columns[2:]), F.lit(True).alias("all"), F.lit(True).alias("by_key")))
    step = lambda a, b, c: F.struct(F.lit(a).alias("r"), F.lit(b).alias("s"), F.lit(c).alias("a"))
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    ahead = F.array(*(step(*x) for x in steps if x > (0, 0, 0)))
    around = looking.withColumn("d", F.explode(F.when(F.col("all"), F.array(*(step(*x) for x in steps))).otherwise(ahead)))
    x, y, z = F.col("r_i") + F.col("d.r"), F.col("s_i") + F.col("d.s"), F.col("a_i") + F.col("d.a")
    if s.wrap_sectors:
        y = F.pmod(y, F.lit(s.sector_num))
    inside = x.between(0, s.range_num - 1) & y.between(0, s.sector_num - 1) & z.between(0, s.azimuth_num - 1)
    keyed = around.where(inside).select("frame_id", F.col("voxel").alias("u"), voxel_key(x, y, z, s).alias("v"), "by_key").where("u <> v")
    met = keyed.join(voxels.select("frame_id", F.col("voxel").alias("v"), odd.alias("v_odd")), ["frame_id", "v"])
    return met.where("not (by_key and v_odd)").select("frame_id", "u", "v")


def voxel_components(voxels: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, voxel, cluster_id): clusters are components of neighbouring voxels, named by their least voxel."""
    edges = joined_voxels(voxels, s)
    node = lambda v: F.col("frame_id").cast("long") * FRAME + F.col(v) - LEAST_KEY
    found = connected_components(edges.select(node("u").alias("a"), node("v").alias("b")))
    place = lambda c: F.pmod(F.col(c), F.lit(FRAME)) + LEAST_KEY
    named = found.select(F.floor(F.col("node") / FRAME).cast("int").alias("frame_id"), place("node").alias("voxel"), place("component").alias("label"))
    return voxels.select("frame_id", "voxel").join(named, ["frame_id", "voxel"], "left").select("frame_id", "voxel", F.coalesce("label", "voxel").alias("cluster_id"))


