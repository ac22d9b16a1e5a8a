"""Clusters: boxes, filters, descriptors, types, intensity fusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUILDING_TYPE, CAR_TYPE, TREE_TYPE, Settings
from ..functions.geometry import polar_angle
from .voxels import neighbour_edges


def cluster_boxes(clustered: DataFrame) -> DataFrame:
    """One row per cluster: points, voxels, bounding box, centroid. Voxels are summed up first, so each is counted once."""
    per_voxel = clustered.groupBy("frame_id", "cluster_id", "voxel").agg(F.count("*").alias("k"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum)) for c in "xyz"))
    return per_voxel.groupBy("frame_id", "cluster_id").agg(
        F.sum("k").alias("n_pts"), F.count("*").alias("n_vox"), *(f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"), *((F.sum(f"sum_{c}") / F.sum("k")).alias(f"mean_{c}") for c in "xyz")
    )


def drop_reason(s: Settings) -> Column:
    """Why a cluster is left out, the first reason that holds; null for those that stay."""
    return F.when(F.col("min_z") > 0, "floating").when(F.col("n_pts") < s.to_be_class, "small").when(F.col("max_z") - F.col("min_z") < 0.2, "flat")


def kept_clusters(boxes: DataFrame, s: Settings) -> DataFrame:
    """The boxes that no reason leaves out."""
    return boxes.where(drop_reason(s).isNull())


def with_descriptor(boxes: DataFrame) -> DataFrame:
    """Adds the eleven-value descriptor; its last place holds the type where boxes have one, else 0."""
    kind = F.coalesce(F.col("type").cast("double"), F.lit(0.0)) if "type" in boxes.columns else F.lit(0.0)
    turn = F.abs(polar_angle(F.col("max_x"), F.col("max_y")) - polar_angle(F.col("min_x"), F.col("min_y")))
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return boxes.withColumn("descriptor", F.array(*[F.lit(1.0)] * 6, F.col("max_z"), area, turn, F.col("min_z"), kind))


def object_type(planar: Column, s: Settings) -> Column:
    """Large objects are buildings if planar, else trees; small low ones are cars, the rest trees."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    car = (F.col("min_z") < s.min_z) & (area < s.car_square) & (F.col("max_z") < s.max_z)
    return F.when(area > s.car_square, F.when(planar, BUILDING_TYPE).otherwise(TREE_TYPE)).when(car, CAR_TYPE).otherwise(TREE_TYPE)


def similar_edges(voxels: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, u, v): neighbours within search_c whose spread is low and whose mean intensities are close."""
    edges = neighbour_edges(voxels, s, s.search_c, ("i_mean", "i_var"))
    return edges.where((F.col("v_i_var") <= s.intensity_cov) & (F.abs(F.col("u_i_mean") - F.col("v_i_mean")) <= s.intensity_diff)).select("frame_id", "u", "v")


def _fuse(iterations: int):
    """Greedy rounds over one frame's cluster graph, clusters in descending order of their first voxel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = int(pdf["frame_id"].iloc[0])
        reach: dict[int, set[int]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            reach.setdefault(int(a), set())
            if b == b and b is not None:
                reach[int(a)].add(int(b))
        name = {c: c for c in reach}  # original cluster -> what it is called now
        first = {c: c for c in reach}  # current cluster -> its first voxel
        for _ in range(iterations):
            members: dict[int, list[int]] = {}
            for c, n in name.items():
                members.setdefault(n, []).append(c)
            claimed: set[int] = set()
            fusions: list[list[int]] = []
            for c in sorted(members, key=lambda c: -first[c]):
                if c in claimed:
                    continue
                found = sorted({name[b] for m in members[c] for b in reach[m] if b in name} - claimed)
                if len(found) > 1:
                    claimed.update(found)
                    fusions.append(found)
            for group in fusions:
                first[group[-1]] = first[group[0]]
                for g in group:
                    for m in members[g]:
                        name[m] = group[-1]
        return pd.DataFrame({"frame_id": frame, "cluster_id": list(name), "fused_id": [name[c] for c in name]})

    return run


def intensity_fusion(voxels: DataFrame, components: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, cluster_id, fused_id). Only the distinct cluster pairs of a frame, not its voxels, meet in one task."""
    edges = similar_edges(voxels, s)
    a = components.select("frame_id", F.col("voxel").alias("u"), F.col("cluster_id").alias("a"))
    b = components.select("frame_id", F.col("voxel").alias("v"), F.col("cluster_id").alias("b"))
    graph = edges.join(a, ["frame_id", "u"]).join(b, ["frame_id", "v"]).select("frame_id", "a", "b").distinct()
    alone = components.select("frame_id", F.col("cluster_id").alias("a"), F.lit(None).cast("long").alias("b")).distinct()
    return graph.unionByName(alone).groupBy("frame_id").applyInPandas(_fuse(s.iteration), "frame_id int, cluster_id long, fused_id long")


def cluster_order(components: DataFrame) -> DataFrame:
    """(frame_id, cluster_id, first, place): a frame's clusters in descending order of their first voxel, from 1."""
    firsts = components.groupBy("frame_id", "cluster_id").agg(F.min("voxel").alias("first"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("first"))))


def gathered(rows: DataFrame, indexes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a list of indexes names, each as often as it is named: the list joins by its keys."""
    return indexes.select(*keys).join(rows, keys)
