"""From scans to tracked objects: ground, voxels, clusters, intensity fusion, box filter, types, states."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import MOVING, Settings
from ..operators import ground, planarity, segments, tracking, voxels
from .tables import written


@dataclass
class Segmented:
    """points: with voxel and cluster_id. clusters: boxes with drop_reason, and type, planar, state, track_id of those that
    stay. voxels: with cluster_id. seconds, rows: wall time of each stage, and its rows, counted while they are written."""

    points: DataFrame
    voxels: DataFrame
    clusters: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    def counters(self) -> DataFrame:
        """(frame_id, in_grid, voxels, fused, kept, tracked, dynamic), a row per frame."""
        c = F.col
        return self.clusters.groupBy("frame_id").agg(
            F.sum("n_pts").alias("in_grid"), F.sum("n_vox").alias("voxels"), F.count("*").alias("fused"), F.count_if(c("drop_reason").isNull()).alias("kept"),
            F.count_if(c("track_id").isNotNull()).alias("tracked"), F.count_if(c("state") == MOVING).alias("dynamic"),
        )

    def write_seconds(self, path: str) -> None:
        """The stages' times and rows as one tab-separated line a stage."""
        rows = [(k, n, v, self.rows[n]) for k, (n, v) in enumerate(self.seconds.items())]
        self.points.sparkSession.createDataFrame(rows, "ordinal int, stage string, seconds double, rows long").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


class _Stages:
    """Writes each stage once, so that none is computed again for the next; keeps times and rows."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        began, seen = time.time(), Observation(name)
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.seconds[name], self.rows[name] = time.time() - began, seen.get["rows"]
        return out


def segment_scans(points: DataFrame, s: Settings, poses: DataFrame | None = None, sequences: DataFrame | None = None) -> Segmented:
    """segment() of what stands on the ground of whole scans (frame_id, x, y, z, refl): the ground is split off first. What lies
    outside all zones, or in patches of too few points, is neither."""
    stage = _Stages()
    split = stage("ground", ground.ground_split(points, s.sensor_height))
    return segment(split.where("status = 'in_grid'").drop("status"), s, poses, sequences, stage)


def segment(points: DataFrame, s: Settings, poses: DataFrame | None = None, sequences: DataFrame | None = None, stage: _Stages | None = None) -> Segmented:
    """Objects of every frame and their states.

    points: frame_id, x, y, z, refl, without ground. poses: as for tracking.moved_points(). A cluster that the fold merged
    into a new one has no state of its own.
    """
    stage = stage or _Stages()
    keys = ["frame_id", "cluster_id"]
    bins = stage("bins", voxels.binned(points, s))
    stats = stage("voxels", voxels.voxel_stats(bins))
    found = stage("components", voxels.voxel_components(stats, s))
    fused = segments.intensity_fusion(stats, found, s)
    named = stage("fused", found.join(fused, keys).select("frame_id", "voxel", F.col("fused_id").alias("cluster_id")))
    pts = bins.join(named, ["frame_id", "voxel"])
    boxes = stage("boxes", segments.cluster_boxes(pts))
    kept = segments.kept_clusters(boxes, s)
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    flat = planarity.planarity(pts.join(kept.where(area > s.car_square).select(*keys), keys, "left_semi")).select(*keys, "planar")
    typed = stage("typed", kept.join(flat, keys, "left").withColumn("planar", F.coalesce("planar", F.lit(False))).withColumn("type", segments.object_type(F.col("planar"), s)))
    live = named.join(typed.select(*keys), keys, "left_semi")
    folded = tracking.tracking_fold(pts.join(typed.select(*keys), keys, "left_semi"), live, typed, s, poses, sequences)
    states = stage("states", folded.select(*keys, F.col("type").alias("late_type"), "state", "track_id"))
    own = typed.select(*keys, "planar", "type").join(states, keys, "left").withColumn("type", F.coalesce("late_type", "type")).drop("late_type")
    clusters = boxes.withColumn("drop_reason", segments.drop_reason(s)).join(own, keys, "left")
    return Segmented(pts, stats.join(named, ["frame_id", "voxel"]), clusters, stage.seconds, stage.rows)
