"""What must not grow faster than the input."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanweave.config import ROAD
from scanweave.fixtures import poses
from scanweave.functions.geometry import computed
from scanweave.operators import planarity, tiles, tracking, voxels
from scanweave.sources import frames


def test_moved_points_compute_each_angle_once(spark):
    points = spark.range(500).selectExpr("cast(id % 3 as int) frame_id", "id cluster_id", "id % 17 - 8.0D x", "id % 13 - 6.0D y", "id % 5 - 2.0D z")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "frame_id int, next_frame int")
    moved = voxels.binned(tracking.moved_points(points, pairs, poses(spark, 3)), ROAD)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("ATAN2") <= 3 and len(plan) < 20000


def test_computed_keeps_rows_and_order_of_columns(spark):
    df = computed(spark.range(3).selectExpr("id a", "id * 2 b"), {"a": F.col("b") + 1, "c": F.col("a") - 1})
    assert df.columns == ["a", "b", "c"] and [tuple(r) for r in df.orderBy("b").collect()] == [(1, 0, -1), (3, 2, 0), (5, 4, 1)]


def test_regions_over_many_tiles_are_those_of_the_whole_cluster(spark, monkeypatch):
    rng = np.random.default_rng(5)
    wall = np.c_[rng.uniform(0, 12, 1500), np.round(rng.normal(0, 0.02, 1500), 2), rng.uniform(-1, 3, 1500)]
    bent = np.c_[rng.uniform(-6, 6, (1200, 2)), np.zeros(1200)]
    bent[:, 2] = np.abs(bent[:, 0]) * 0.15 + rng.normal(0, 0.02, 1200)
    clusters = {3: np.r_[wall, wall[:40]], 5: bent, 7: rng.uniform(0, 4, (1000, 3)), 9: bent[:19], 11: bent[:4]}
    rows = [(1, c, *map(float, p)) for c, xyz in clusters.items() for p in xyz]
    df = spark.createDataFrame(rows, "frame_id int, cluster_id long, x double, y double, z double").repartition(3)
    monkeypatch.setattr(tiles, "FULL", 150)
    monkeypatch.setattr(planarity, "grown_points", None)  # nothing may hold a whole cluster
    got = {r.cluster_id: (r.n_pts, r.grown, r.planar) for r in planarity.planarity(df).collect()}
    monkeypatch.undo()
    for c, xyz in clusters.items():
        grown = planarity.grown_points(xyz[np.lexsort(xyz.T[::-1])])
        assert got[c] == (len(xyz), grown, grown >= 0.2 * len(xyz))
    assert planarity.planarity(df.limit(0)).count() == 0


def test_a_frame_passes_through_its_task_in_parts(spark, tmp_path):
    rows, parts = 20000, 120
    columns = ("frame_id", "x", "y", "z", "r", "g", "b")
    schema = StructType.fromDDL("frame_id int, " + ", ".join(f"{c} double" for c in columns[1:]))

    def batches():
        for p in range(parts):
            at = np.arange(p * rows, (p + 1) * rows, dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(at < 5, 1, 2).astype(np.int32)), *(pa.array(at + c) for c in range(3)), *(pa.array((at + c) % 256) for c in range(3))], list(columns))

    tracemalloc.start()
    writer = frames.FrameWriter(str(tmp_path), "cloud", schema, False)
    writer.commit([writer.write(batches())])
    reader = frames.FrameReader(str(tmp_path), "cloud", StructType.fromDDL("frame_id int, k bigint, x double, b double"), 1 << 30)
    seen, total = 0, 0.0
    for batch in reader.read(reader.partitions()[0]):
        x = batch.column(2).to_numpy()
        assert batch.column(1).to_numpy()[0] == (0 if seen < 5 else seen - 5) and x[0] == seen and (batch.column(3).to_numpy() == (x + 2) % 256).all()
        seen, total = seen + len(x), total + x.sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = rows * parts
    assert seen == n and total == n * (n - 1) / 2
    assert peak < n * 16  # bytes: less than the file, of which several copies in doubles were held
