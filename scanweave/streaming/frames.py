"""Scans as a stream: voxel statistics per frame, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.voxels import binned


def stream_voxel_stats(points: DataFrame, s: Settings, lateness: str = "10 seconds") -> DataFrame:
    """Voxel statistics of a stream of points with an event time `ts`; a frame closes when the watermark has passed it."""
    stamped = binned(points.withWatermark("ts", lateness), s)
    return stamped.groupBy(F.window("ts", "1 second"), "frame_id", "voxel").agg(F.count("*").alias("n"), F.avg("refl").alias("i_mean"), F.var_pop("refl").alias("i_var"))
