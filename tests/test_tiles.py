"""Tiles of space: joins and neighbours against all pairs, on dense places and with equal distances."""

import shutil

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave import catalogue
from scanweave.operators import ground, neighbours, spatial, tiles, voxels
from scanweave.plans import tables


@pytest.mark.parametrize("radius", [0.5, 1.0, 2.0, 9.0])
def test_grid_search_against_all_pairs(radius):
    rng = np.random.default_rng(3)
    for n, m, side in ((200, 300, 12), (50, 900, 4), (3, 5, 2)):
        a, b = rng.integers(0, side, (n, 3)).astype(float), rng.integers(0, side, (m, 3)).astype(float)
        d = ((a[:, None] - b[None]) ** 2).sum(2)
        at, far = tiles.nearest_of(a, b, radius)
        assert (at == np.where(d.min(1) <= radius**2, d.argmin(1), -1)).all() and (far[at >= 0] == d.min(1)[at >= 0]).all()
        found = {int(w): near.tolist() for which, rows, _ in tiles.k_nearest_of(a, b, 10, 99.0, True) for w, near in zip(which, rows)}
        assert [found[k] for k in range(n)] == np.argsort(d, axis=1, kind="stable")[:, :10].tolist()


def test_joins_over_borders_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FULL", 40)
    rng = np.random.default_rng(4)
    frame = lambda n: pd.DataFrame({"f": rng.integers(0, 2, n), "k": np.arange(n), **dict(zip("xyz", rng.integers(-9, 9, (3, n)).astype(float)))})
    a, b = frame(400), frame(300)
    pairs = a.merge(b, on="f", suffixes=("", "_r"))
    pairs["d2"] = sum((pairs[c] - pairs[f"{c}_r"]) ** 2 for c in "xyz")
    pairs = pairs[pairs.d2 <= 4].sort_values(["k", "d2", "k_r"]).drop_duplicates("k")
    left, right = spark.createDataFrame(a).unionByName(spark.sql("select 0L f, 400L k, double(null) x, 0D y, 0D z")), spark.createDataFrame(b)
    near = spatial.nearest(left, right, 2.0, ["f"], ["f", "k"], [F.col("r_k")]).select("k", "near.r_k", "near.d2").collect()
    assert sorted(map(tuple, near)) == list(zip(pairs.k, pairs.k_r, pairs.d2))
    assert sorted(r.k for r in spatial.within(left, right, 2.0, ["f"], ["f", "k"]).collect()) == sorted(pairs.k)
    assert sorted(r.k for r in spatial.beyond(left, right, 2.0, ["f"], ["f", "k"]).collect()) == sorted(set(range(401)) - set(pairs.k))


def test_lonely_points_meet_no_dense_cloud_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FULL", 200)
    rng = np.random.default_rng(6)
    # three groups: a cloud with lonely points at several distances, a lattice with many equal distances, and fewer points than neighbours
    cloud = np.r_[rng.uniform(0, 4, (3000, 3)), rng.uniform(5, 9, (15, 3)), rng.uniform(20, 60, (6, 3)), [[-50.0, 3, 3]]]
    lattice = np.c_[np.arange(900) % 30, np.arange(900) // 30, np.zeros(900)] * 2.0
    groups = {1: cloud, 2: lattice, 3: rng.uniform(-60, 60, (7, 3))}
    rows = [(f, k, *map(float, p)) for f, xyz in groups.items() for k, p in enumerate(xyz)]
    points = spark.createDataFrame(rows, "f int, k long, x double, y double, z double").repartition(3)

    def seen(tile, who, near, far):
        k = tile.column("k")
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * near.shape[1], pa.int32()), k.take(pa.array(near.ravel())).combine_chunks())
        return [*(tile.column(c).take(pa.array(who)) for c in ("f", "k", "x", "y", "z")), each, pa.array(np.full(len(who), len(tile)))]

    got = neighbours.near_rows(points, 10, ["f"], ["k"], seen, "near array<long>, held long", "held").collect()
    assert max(r.held for r in got) < 1500
    found = {(r.f, r.k): r.near for r in got}
    assert len(got) == len(found) == len(rows)
    for f, xyz in groups.items():
        d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
        assert [found[f, k] for k in range(len(xyz))] == np.argsort(d, axis=1, kind="stable")[:, :10].tolist()


def test_dense_clouds_do_not_meet_pair_by_pair(spark):
    # 30,000 by 30,000 points within one radius: lists of cells would hold all of them for each
    cloud = lambda by: spark.range(30000).selectExpr("0 f", "id k", f"double(id % 31) + {by} x", "double(id div 31 % 31) y", "double(id div 961) z")
    near = spatial.nearest(cloud(0.25), cloud(0.0), 100.0, ["f"], ["f", "k"], [F.col("r_k")])
    assert near.where("k = near.r_k and near.d2 = 0.0625").count() == 30000


def test_variance_of_whole_numbers_is_exact(spark):
    # 100 values of 0 and 40, half each: their variance is 400 in any order and partitioning
    bins = spark.range(7000).selectExpr("0 frame_id", "id % 70 voxel", "0L r_i", "0L s_i", "0L a_i", "if((id div 70) % 2 = 0, 0L, 40L) + id % 70 refl").repartition(16)
    assert [r.i_var for r in voxels.voxel_stats(bins).collect()] == [400.0] * 70


def test_ground_of_patches_follows_the_rule_of_one(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"frame_id": np.repeat([0, 1], 3000), "k": np.arange(6000), "x": rng.uniform(-30, 30, 6000), "y": rng.uniform(-30, 30, 6000)})
    pdf["z"] = np.where(pdf.k % 3 > 0, -1.73 + 0.02 * pdf.x + rng.normal(0, 0.03, 6000), rng.uniform(-1.7, 2, 6000))
    pts = spark.createDataFrame(pdf).withColumn("frame_id", F.col("frame_id").cast("int")).repartition(5)
    got = {r.k: r.status for r in ground.ground_split(pts, 1.73).collect()}
    zoned = ground.with_zones(pts, 1.73).toPandas()
    assert len(got) == len(zoned)
    want = dict.fromkeys(zoned.k, "unassigned")
    for (_, zone, ring, _), patch in zoned.groupby(ground.PATCH):
        if len(patch) > ground.LEAST_POINTS:
            want |= zip(patch.k, np.where(ground.is_ground(patch[["x", "y", "z"]].to_numpy(), int(zone), int(ring), 1.73), "ground", "in_grid"))
    assert got == want and {"ground", "in_grid", "unassigned"} <= set(got.values())
    plan = ground.ground_split(pts, 1.73)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_ten_nearest_moves_no_row_for_each_neighbour(spark):
    plan = catalogue.QUERIES["ten_nearest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_only_points_at_borders_of_tiles_ask_again(spark, monkeypatch):
    # tiles reach less far than most tenth neighbours are away: inside of a tile they are found all the same
    monkeypatch.setattr(tiles, "FULL", 3000)
    rng = np.random.default_rng(8)
    xyz = np.r_[rng.uniform(0, 10, (20000, 3)), [[30.0, 3, 3]]]
    points = spark.createDataFrame([(1, k, *p) for k, p in enumerate(xyz.tolist())], "f int, k long, x double, y double, z double")
    asked, written = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, label: asked.append((label, written(df, label))) or asked[-1][1])
    got = {r.k: (r.n, r.d2) for r in neighbours.k_spreads(points, 10, ["f"], ["k"]).select("k", "n", "d2").collect()}
    again = [df for label, df in asked if label == "asking"]
    assert again and sum(df.select("k").distinct().count() for df in again) < 8000
    for i in [*range(0, 20000, 97), 20000]:
        assert got[i] == (10, np.sort(((xyz - xyz[i]) ** 2).sum(1))[9])
    assert len(got) == len(xyz)


def test_calibration_writes_the_places_and_a_number_for_each(spark, tmp_path, monkeypatch):
    shutil.copy("/root/testdata/sf0.001/lineitem.parquet", tmp_path)
    seen = []
    for module in (tables, neighbours):
        monkeypatch.setattr(module, "written", lambda df, label, real=module.written: seen.append((label, df.columns)) or real(df, label))
    catalogue.QUERIES["intensity_calibration"](spark, str(tmp_path))
    at = ["x", "y", "z"]
    assert [s for s in seen if s[0] not in ("asking", "tiles")][:2] == [("places", ["frame_id", "x_mm", "y_mm", "z_mm", "intensity"]), ("neighbours", ["frame_id", *at, "intensity", "__cosine", "__within"])]


def test_tiles_are_cut_by_their_points(spark):
    cloud = spark.range(200000).selectExpr("0 f", "double(id % 448) x", "double(id div 448) y", "0D z")
    full = lambda w: cloud.groupBy(tiles.tile_index("x", w), tiles.tile_index("y", w)).count().agg(F.max("count")).first()[0]
    width = tiles.tile_width(cloud, ["f"], tiles.extent_of(cloud))
    # no more than FULL points, and the next width has more
    assert full(width) <= tiles.FULL < full(width * 1.5)


@pytest.mark.parametrize("flat", [0.0, 1e-3, 1.0])
def test_axes_of_least_spread_against_numpy(flat):
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(500, 3, 3)))[0]
    at = np.einsum("nij,nkj->nki", turn, rng.normal(size=(500, 10, 3)) * [3, 1, flat])
    covariances = neighbours._covariances(at, at.sum(1))
    axis, share = neighbours.least_axis(*covariances)
    values, vectors = np.linalg.eigh(np.stack([covariances[k] for k in (0, 1, 2, 1, 3, 4, 2, 4, 5)], 1).reshape(-1, 3, 3))
    sure = values[:, 1] - values[:, 0] > 1e-3 * values[:, 2]
    assert np.array_equal(~np.isnan(axis).any(1), sure) and np.allclose(np.abs((axis * vectors[:, :, 0]).sum(1))[sure], 1, atol=1e-7)
    assert np.allclose(share, np.abs(values[:, 0]) / values.sum(1), atol=1e-9)
    on_a_line = np.outer(np.arange(10.0), [1, 2, 3])[None]
    assert np.isnan(neighbours.least_axis(*neighbours._covariances(on_a_line, on_a_line.sum(1)))[0]).all()


def test_normals_of_planes_and_lines(spark):
    plane = spark.range(900).selectExpr("1 f", "id k", "double(id % 30) x", "double(id div 30) y", "2 * double(id % 30) z")
    line = spark.range(40).selectExpr("2 f", "id k", "double(id) x", "0D y", "0D z")
    got = neighbours.normals(plane.unionByName(line).unionByName(spark.sql("select 3 f, 0L k, 1D x, 1D y, 1D z")), 10, ["f"], ["k"]).collect()
    assert len(got) == 941 and all(r.nx is r.ny is r.nz is None and r.curvature < 1e-9 for r in got if r.f > 1)
    found = np.array([[r.nx, r.ny, r.nz, r.curvature] for r in got if r.f == 1])
    assert np.allclose(np.abs(found), [2 / 5**0.5, 0, 1 / 5**0.5, 0], atol=1e-7) and (found[:, 0] * found[:, 2] < 0).all()
