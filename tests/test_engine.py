"""The point-cloud queries against DuckDB on the smallest scene, kernels against plain versions, files by round trips."""

import numpy as np
import pandas as pd
import pytest
from oracle import check
from pyspark.sql import functions as F

from scanweave import catalogue
from scanweave.config import CAR_TYPE, PARKING, ROAD, Settings
from scanweave.operators import ground, planarity, segments, tracking, voxels
from scanweave.plans import segmentation
from scanweave.plans.components import connected_components
from scanweave.sources import scans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    check(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_presets_have_the_known_grids():
    assert (ROAD.range_num, ROAD.sector_num, ROAD.azimuth_num) == (72, 300, 60)
    assert (PARKING.range_num, PARKING.sector_num, PARKING.azimuth_num) == (98, 300, 45)


def test_settings_from_a_file(tmp_path):
    (tmp_path / "s.yaml").write_text("common:\n  skip_: 3\nssc:\n  toBeClass_: 12\n  max_dis_: 40\n  dynamic_label_: [252, 253]\n  other_: 1\nfeature:\n")
    s = Settings.from_file(str(tmp_path / "s.yaml"))
    assert (s.skip, s.to_be_class, s.max_dis, s.dynamic_label, s.start) == (3, 12, 40.0, (252, 253), 5)


def test_neighbours_by_cells_are_the_nearest():
    rng = np.random.default_rng(7)
    for xyz in (rng.random((1500, 3)), np.c_[rng.random((1500, 2)) * 9, np.zeros(1500)], np.repeat(rng.random((40, 3)), 30, 0), np.zeros((300, 3)), rng.random((3, 3)), np.zeros((0, 3))):
        d = ((xyz[:, None, :] - xyz[None]) ** 2).sum(-1)
        assert (planarity.nearest(xyz, 10) == np.argsort(d, axis=1, kind="stable")[:, :10]).all()


def test_lower_bounds_alias_to_the_sector_before(spark):
    p = spark.createDataFrame([(0, 10.0, 0.0, 0.0)], "frame_id int, x double, y double, z double")
    r = voxels.binned(p, ROAD).first()
    assert r["s_i"] == -1 and r["voxel"] == r["a_i"] * 21600 + r["r_i"] * 300 - 1


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = rng.integers(0, 300, (220, 2)).tolist() + [[k, k + 1] for k in range(1000, 1060)] + [[7, 7]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    by_steps = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), one_task_edges=0)
    assert {r["node"]: r["component"] for r in by_steps.collect()} == got


def test_joined_voxels_have_the_components_of_all_edges(spark):
    # voxels on lower bounds stand at their neighbours' keys, among voxels that lie there
    rng = np.random.default_rng(9)
    small = ROAD.but(max_dis=4.0, min_azimuth=-6.0, max_azimuth=6.0, sector_res=30.0)
    rows = [(0, int(r), int(s), int(a)) for r, s, a in set(map(tuple, rng.integers([-1, -1, -1], [small.range_num, small.sector_num, small.azimuth_num], (60, 3))))]
    v = spark.createDataFrame(rows, "frame_id int, r_i long, s_i long, a_i long")
    for wrap in (False, True):
        s = small.but(wrap_sectors=wrap)
        v2 = v.withColumn("voxel", voxels.voxel_key(v.r_i, v.s_i, v.a_i, s)).groupBy("frame_id", "voxel").agg(*(F.min(c).alias(c) for c in ("r_i", "s_i", "a_i")))
        pairs = lambda df: {frozenset((r["u"], r["v"])) for r in df.collect() if r["u"] != r["v"]}
        assert pairs(voxels.neighbour_edges(v2, s)) <= pairs(voxels.joined_voxels(v2, s))
        assert pairs(voxels.joined_voxels(v2, s)) <= pairs(voxels.neighbour_edges(v2, s))


def test_plane_and_ground():
    rng = np.random.default_rng(1)
    flat = np.c_[rng.uniform(3, 8, (200, 2)), rng.normal(-1.73, 0.01, 200)]
    pole = np.c_[np.full((40, 2), 5.0), np.linspace(-1, 1, 40)]
    hit = ground.is_ground(np.r_[flat, pole], 0, 0, 1.73)
    assert hit[:200].all() and not hit[200:].any()
    normal, _, _ = ground.plane(flat)
    assert normal[2] > 0.99
    # a raised, rough patch is no ground in the four rings nearest to the sensor, in whatever zone they lie
    rough = np.c_[rng.uniform(13, 16, (300, 2)), rng.normal(-0.5, 0.05, 300)]
    assert [bool(ground.is_ground(rough, zone, ring, 1.73).any()) for zone, ring in ((0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0))] == [False] * 4 + [True] * 2


def plain_split(points, height):
    """Ground of one scan, patch by patch, from the rules alone."""
    status = {}
    patches = {}
    for k, (x, y, z) in enumerate(points):
        if z < -1.8 * height:
            continue
        r, turn = np.hypot(x, y), np.arctan2(y, x) % (2 * np.pi)
        status[k] = "unassigned"
        if 2.7 < r <= 80:
            zone = int(np.searchsorted((12.3625, 22.025, 41.35), r, "right"))
            low, high = ground.BORDERS[zone], ground.BORDERS[zone + 1]
            ring = min(int((r - low) / ((high - low) / ground.RINGS[zone])), ground.RINGS[zone] - 1)
            sector = min(int(turn / (2 * np.pi / ground.SECTORS[zone])), ground.SECTORS[zone] - 1)
            patches.setdefault((zone, ring, sector), []).append(k)
    for (zone, ring, _), ks in patches.items():
        if len(ks) <= 10:
            continue
        p = points[ks]
        low = sorted(z for z in p[:, 2] if zone or z >= -1.1 * height)[:20]
        inside = p[:, 2] < (np.mean(low) if low else 0.0) + 0.3
        for _ in range(3):
            if not inside.any():
                break
            mean = p[inside].mean(0)
            _, spread, axes = np.linalg.svd(np.cov(p[inside].T, bias=True))
            normal = axes[2] * (1 if axes[2, 2] >= 0 else -1)
            inside = (p - mean) @ normal < 0.1
        good = inside.any() and abs(normal[2]) >= 0.707
        number = {0: ring, 1: 2 + ring}.get(zone, 9)
        if good and number < 4 and mean[2] > ground.ELEVATION[number]:
            good = spread[2] / spread.sum() < ground.FLATNESS[number]
        for k, i in zip(ks, inside):
            status[k] = "ground" if good and i else "in_grid"
    return status


def test_ground_split_against_plain_rules(spark):
    rng = np.random.default_rng(3)
    n = 6000
    turn, far = rng.uniform(0, 2 * np.pi, n), rng.uniform(1, 50, n)
    height = np.where(rng.random(n) < 0.6, rng.normal(-1.7, 0.03, n), rng.uniform(-1.5, 2, n)) + np.where(turn < 1, 1.2, 0)
    xyz = np.round(np.c_[far * np.cos(turn), far * np.sin(turn), height], 6)
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(frame_id=np.int32(0), k=np.arange(n))
    got = {r["k"]: r["status"] for r in ground.ground_split(spark.createDataFrame(pdf, "x double, y double, z double, frame_id int, k long"), 1.73).collect()}
    want = plain_split(xyz, 1.73)
    assert got == want and set(want.values()) == {"ground", "in_grid", "unassigned"}


def test_planarity_of_walls_and_noise():
    rng = np.random.default_rng(2)
    wall = np.c_[rng.uniform(0, 4, 300), np.zeros(300), rng.uniform(0, 3, 300)]
    assert planarity.grown_points(wall) >= 290
    assert planarity.grown_points(rng.uniform(0, 3, (300, 3))) < 150
    assert planarity.grown_points(wall[:19]) == 0


def test_fusion_takes_the_largest_name_and_leaves_loners():
    import pandas as pd

    rows = [(0, 10, 20), (0, 10, 10), (0, 20, 10), (0, 20, 20), (0, 30, 30), (0, 40, None)]
    out = segments._fuse(3)(pd.DataFrame(rows, columns=["frame_id", "a", "b"]))
    assert dict(zip(out.cluster_id, out.fused_id)) == {10: 20, 20: 20, 30: 30, 40: 40}


def folded(frames, hits, occupancy=0.4):
    """fold() of frame -> cluster -> (type, voxels), where hits are (frame, cluster) -> later frame -> voxels; made clusters by number."""
    of = {f: {v: c for c, (_, vs) in own.items() for v in vs} for f, own in frames.items()}
    sizes = {f: {c: (kind, len(vs)) for c, (kind, vs) in own.items()} for f, own in frames.items()}
    rows = tracking.fold(sizes, {car: {g: {v: of[g][v] for v in vs if v in of[g]} for g, vs in ahead.items()} for car, ahead in hits.items()}, occupancy, max(frames))
    made = sorted({m for _, _, m, *_ in rows if m})
    tracks = sorted({t for *_, t in rows if t})
    base = 1 + max(c for own in frames.values() for c in own)
    return [(f, base + made.index(m) if m else c, kind, state, tracks.index(t)) for f, c, m, kind, state, t in rows if kind is not None]


def test_fold_states_and_tracks():
    car = CAR_TYPE
    same = {(0, 1): {1: {1, 2}}}
    assert folded({0: {1: (car, {1, 2})}, 1: {5: (car, {1, 2})}}, same) == [(0, 1, car, 0, 0), (1, 5, car, -1, 0)]
    assert folded({0: {1: (car, {1})}, 1: {5: (car, {9})}}, {(0, 1): {1: {1}}}) == [(0, 1, car, 1, 0), (1, 5, car, -1, 1)]
    split = folded({0: {1: (car, {1})}, 1: {5: (1, {1, 2, 3, 4})}}, {(0, 1): {1: {1}}})
    assert split == [(0, 1, 1, 0, 0)]
    joined = {0: {1: (car, {1, 2})}, 1: {5: (car, {1}), 6: (car, {2})}}
    assert folded(joined, same) == [(0, 1, car, 0, 0), (1, 7, car, -1, 0)]
    # a car that was made from two moves with the points of both
    longer = joined | {2: {8: (car, {3}), 9: (1, {4, 5, 6, 7})}}
    assert folded(longer, same | {(1, 5): {2: {3}}}) == [(0, 1, car, 0, 0), (1, 10, car, 0, 0), (2, 8, car, -1, 0)]
    assert folded(longer, same | {(1, 5): {2: {3}}, (1, 6): {2: {4}}})[1] == (1, 10, car, 0, 0)
    # what a car took from another cluster is not there for the next car
    taken = {0: {1: (car, {1}), 2: (car, {2})}, 1: {5: (0, {1, 2, 3, 4, 5, 6})}}
    assert [r[:4] for r in folded(taken, {(0, 1): {1: {1}}, (0, 2): {1: {1}}})] == [(0, 1, 0, 0), (0, 2, car, -1)]


def test_bin_keys_equal_binned(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 15, (4000, 3)), [[0, 0, 0], [0, 0, 3], [5, 0, 0], [-5, 0, 0], [0, -5, 1], [1e6, 0, 0]]])
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=["x", "y", "z"]))
    for s in (ROAD, PARKING):
        assert sorted(voxels.bin_keys(xyz, s).tolist()) == sorted(r["voxel"] for r in voxels.binned(df, s).collect())
    assert voxels.bin_keys(np.zeros((0, 3)), ROAD).tolist() == []


def test_a_standing_car_hands_its_points_on():
    car = CAR_TYPE
    frames = {0: {1: (car, {1, 2})}, 1: {5: (car, {1})}, 2: {8: (car, {2})}}
    hits = {(0, 1): {1: {1, 2}, 2: {1, 2}}, (1, 5): {2: {1}}}
    assert folded(frames, hits) == [(0, 1, car, 0, 0), (1, 5, car, 0, 0), (2, 8, car, -1, 0)]
    assert folded(frames, hits | {(0, 1): {1: {1, 2}}}) == [(0, 1, car, 0, 0), (1, 5, car, 1, 0), (2, 8, car, -1, 1)]


def _plain_fold(points, types, poses, s):
    """Tracking point by point over plain lists. points: (frame, cluster, voxel, xyz)."""
    def matrix(p):
        out = np.eye(4)
        a, b, c = p["yaw"], p["pitch"], p["roll"]
        z = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
        y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
        x = np.array([[1, 0, 0], [0, np.cos(c), -np.sin(c)], [0, np.sin(c), np.cos(c)]])
        out[:3, :3], out[:3, 3] = z @ y @ x, (p["px"], p["py"], p["pz"])
        return out

    clouds, cells, kinds, seen, result = {}, {}, dict(types), {}, []
    for f, c, v, xyz in points:
        clouds.setdefault((f, c), []).append(xyz)
        cells.setdefault((f, c), set()).add(v)
        seen.setdefault(f, {})[v] = c
    own = {}
    for f, c, v, xyz in points:
        own.setdefault((f, v), []).append(xyz)
    frames, names, fresh, count = sorted(seen), {}, 1 + max(c for _, c in cells), 0
    for f, g in zip(frames, [*frames[1:], None]):
        for c in sorted(c for k, c in cells if k == f and kinds[k, c] == CAR_TYPE):
            if (f, c) not in names:
                names[f, c] = count
                count += 1
            state = -1
            if g is not None:
                m = np.linalg.inv(matrix(poses[g])) @ matrix(poses[f]) if poses else np.eye(4)
                there = [(m @ [*p, 1])[:3] for p in clouds[f, c]]
                found = {}
                for p in there:
                    for v in voxels.bin_keys(p[None, :], s).tolist():
                        if v in seen[g]:
                            found.setdefault(seen[g][v], set()).add(v)
                state = 1 if not found else 0
                enough = {n: len(vs) >= s.occupancy * len(cells[g, n]) for n, vs in found.items()}
                if len(found) == 1:
                    (n, vs), = found.items()
                    if kinds[g, n] == CAR_TYPE:
                        state = 0 if enough[n] else 1
                        if enough[n]:
                            names[g, n] = names[f, c]
                            clouds[g, n] += there
                    elif enough[n]:
                        state = -1
                    else:
                        kinds[f, c] = kinds[g, fresh] = kinds[g, n]
                        cells[g, n], cells[g, fresh], names[g, fresh] = cells[g, n] - vs, vs, names[f, c]
                        seen[g].update({v: fresh for v in vs})
                        fresh += 1
                elif found:
                    joined = [n for n in found if kinds[g, n] == CAR_TYPE and enough[n]]
                    if joined:
                        cells[g, fresh] = set().union(*(cells.pop((g, n)) for n in joined))
                        clouds[g, fresh] = [p for v in cells[g, fresh] for p in own[g, v]]
                        kinds[g, fresh], names[g, fresh] = CAR_TYPE, names[f, c]
                        seen[g].update({v: fresh for v in cells[g, fresh]})
                        fresh += 1
            result.append((f, c, kinds[f, c], state, names[f, c]))
    return result


@pytest.mark.parametrize(("moving", "ahead"), [(False, 1), (True, 8)])
def test_tracking_fold_matches_plain_python(spark, monkeypatch, moving, ahead):
    monkeypatch.setattr(tracking, "AHEAD", ahead)
    found, pts, typed = catalogue.typed_boxes(spark, SF)
    poses = catalogue.poses(spark) if moving else None
    got = sorted(tuple(r) for r in tracking.tracking_fold(pts, found, typed, catalogue.S, poses).collect())
    points = [(r["frame_id"], r["cluster_id"], r["voxel"], (r["x"], r["y"], r["z"])) for r in pts.collect()]
    types = {(r["frame_id"], r["cluster_id"]): r["type"] for r in typed.collect()}
    want = _plain_fold(points, types, {r["frame_id"]: r.asDict() for r in poses.collect()} if moving else {}, catalogue.S)
    assert got == sorted(want) and {r[3] for r in got} >= {-1, 1}


def test_folds_of_two_sequences_stay_apart(spark):
    clustered = spark.createDataFrame([(f, 1, 7, 5.0, 0.5, -1.5) for f in (1, 2, 5, 6)], "frame_id int, cluster_id long, voxel long, x double, y double, z double")
    clustered = voxels.binned(clustered.drop("voxel"), ROAD).select("frame_id", "cluster_id", "voxel", "x", "y", "z")
    typed = clustered.select("frame_id", "cluster_id", F.lit(CAR_TYPE).alias("type"))
    of = lambda sequences: sorted(tuple(r) for r in tracking.tracking_fold(clustered, clustered.select("frame_id", "voxel", "cluster_id"), typed, ROAD, sequences=sequences).collect())
    assert [r[3:] for r in of(None)] == [(0, 0), (0, 0), (0, 0), (-1, 0)]
    two = spark.createDataFrame([(1, "a"), (2, "a"), (5, "b"), (6, "b")], "frame_id int, sequence string")
    assert [r[3:] for r in of(two)] == [(0, 0), (-1, 0), (0, 0), (-1, 0)]


def test_whole_chain_and_its_files(spark, tmp_path):
    done = segmentation.segment(catalogue.objects(spark, SF), ROAD, catalogue.poses(spark))
    clusters = {(r["frame_id"], r["cluster_id"]): r for r in done.clusters.collect()}
    assert {r["type"] for r in clusters.values() if r["drop_reason"]} <= {None}
    assert all(r["type"] is not None for r in clusters.values() if not r["drop_reason"])
    count = {r["frame_id"]: r for r in done.counters().collect()}
    assert sum(r["in_grid"] for r in count.values()) == done.points.count() and all(r["fused"] >= r["kept"] >= r["tracked"] >= r["dynamic"] for r in count.values())
    frames = {k[0] for k, r in clusters.items() if not r["drop_reason"]}
    assert scans.write_segments(done.points, done.clusters, str(tmp_path / "seg")) == len(frames)
    back = scans.read_clouds(spark, str(tmp_path / "seg"), ("x", "y", "z", "rgb")).groupBy("frame_id").count().collect()
    points = {f: sum(r["n_pts"] for k, r in clusters.items() if k[0] == f and not r["drop_reason"]) for f in frames}
    assert {r["frame_id"]: r["count"] for r in back} == points
    assert done.rows["bins"] == done.points.count() and set(done.rows) == set(done.seconds)
    done.write_seconds(str(tmp_path / "times"))
    assert spark.read.csv(str(tmp_path / "times"), sep="\t").count() == len(done.seconds)


@pytest.mark.parametrize("name", ["ground_split", "intensity_fusion", "tracking_fold", "cluster_planarity", "segmented_clusters", "shape_histogram"])
def test_queries_without_sql_run(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    assert found.columns and (found.count() > 0 or name == "cluster_planarity")


def test_ground_split_keeps_every_point(spark):
    p = catalogue.points(spark, SF)
    assert catalogue.QUERIES["ground_split"](spark, SF).groupBy().sum("n").first()[0] == p.where(f"z >= {-1.8 * ROAD.sensor_height}").count()


def test_files_round_trip(spark, tmp_path):
    a = np.array([[1, 2, 3, 0.5], [4, 5, 6, 2.0]], "<f4")
    for folder in ("scans", "labels", "clouds", "objects"):
        (tmp_path / folder).mkdir()
    (tmp_path / "scans/000007.bin").write_bytes(a.tobytes())
    (tmp_path / "scans/000008.bin").write_bytes(b"")
    (tmp_path / "labels/000007.label").write_bytes(np.array([40 | 300 << 16, 252], "<u4").tobytes())
    (tmp_path / "labels/000008.label").write_bytes(b"")
    got = scans.labelled_scans(spark, str(tmp_path / "scans"), str(tmp_path / "labels")).orderBy("k").collect()
    assert [(r["frame_id"], r["x"], r["intensity"], r["label"]) for r in got] == [(7, 1.0, 127.5, 40 | 300 << 16), (7, 4.0, 255.0, 252)]
    (tmp_path / "labels/000009.label").write_bytes(b"")
    with pytest.raises(ValueError):
        scans.labelled_scans(spark, str(tmp_path / "scans"), str(tmp_path / "labels"))
    (tmp_path / "clouds/3.pcd").write_bytes(scans.cloud_bytes(a))
    (tmp_path / "clouds/4.pcd").write_text("FIELDS x y z intensity\nPOINTS 2\nDATA ascii\n1 2 3 4\n\n5 6 7\n")
    got = scans.read_clouds(spark, str(tmp_path / "clouds")).orderBy("frame_id", "k").collect()
    assert [(r["frame_id"], r["z"]) for r in got] == [(3, 3.0), (3, 6.0), (4, 3.0)]
    (tmp_path / "poses.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n0 -1 0 1 1 0 0 2 0 0 1 3\n")
    got = scans.read_poses(spark, str(tmp_path / "poses.txt")).orderBy("frame_id").collect()
    assert [(r["px"], r["r3"]) for r in got] == [(5.0, 0.0), (1.0, 1.0)]
    tr = (0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1)
    m = {r["frame_id"]: r for r in scans.read_poses(spark, str(tmp_path / "poses.txt"), tr).collect()}
    fixed, cam = np.reshape(tr, (4, 4)).astype(float), np.array([[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1.0]])
    want = np.linalg.inv(fixed) @ cam @ fixed
    assert np.allclose([m[1][c] for c in ("px", "py", "pz")], want[:3, 3]) and np.isclose(m[1]["yaw"], np.arctan2(want[1, 0], want[0, 0])) and m[0]["yaw"] == 0
    poses = scans.read_poses(spark, str(tmp_path / "poses.txt"))
    scans.write_poses(poses, str(tmp_path / "poses_again"))
    again = scans.read_poses(spark, str(tmp_path / "poses_again/part-*"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, poses.collect()))
    scans.write_quaternions(poses, str(tmp_path / "turns"), ROAD.but(start=1, end=1))
    (r,) = spark.read.csv(str(tmp_path / "turns"), inferSchema=True).collect()
    assert tuple(r)[:5] == (0, 1, 1.0, 2.0, 3.0) and np.allclose(tuple(r)[5:], (0, 0, np.sqrt(0.5), np.sqrt(0.5)))
    (tmp_path / "way.pcd").write_text("FIELDS x y z roll pitch yaw time\nPOINTS 2\nDATA ascii\n1 2 3 0 0 0.5 10\n2 2 3 0 0 0.6 11\n")
    assert [(r["frame_id"], r["px"], r["yaw"], r["time"]) for r in scans.read_cloud_poses(spark, str(tmp_path / "way.pcd")).collect()] == [(0, 1.0, 0.5, 10.0), (1, 2.0, 0.6, 11.0)]
    (tmp_path / "text").mkdir()
    (tmp_path / "text/5.pcd").write_text("FIELDS x y z\nSIZE 4 4 4\n1 2 3 4\n5 6 7\n5 6 7 8\n\n9 9 9 9\n")
    text = scans.read_text_clouds(spark, str(tmp_path / "text"))
    assert scans.write_scans(text, str(tmp_path / "made")) == 1
    assert [(r["x"], r["intensity"]) for r in scans.read_scans(spark, str(tmp_path / "made"), 1.0).orderBy("k").collect()] == [(1.0, 1.0), (5.0, 1.0)]
    assert scans.write_one_colour(text, str(tmp_path / "red"), 255, 1, 2) == 1
    assert {r["rgb"] for r in scans.read_clouds(spark, str(tmp_path / "red"), ("x", "rgb")).collect()} == {float(255 << 16 | 1 << 8 | 2)}
    assert scans.write_clouds(text, str(tmp_path / "plain")) == 1 and scans.write_clouds(text, str(tmp_path / "none"), save=False) == 0
    assert [r["z"] for r in scans.read_clouds(spark, str(tmp_path / "plain")).orderBy("k").collect()] == [3.0, 7.0]
    with pytest.warns(UserWarning):
        assert scans.write_clouds(text.limit(0), str(tmp_path / "none")) == 0
    (tmp_path / "labels/000009.label").unlink()
    assert scans.labelled_scans(spark, str(tmp_path / "scans"), str(tmp_path / "labels"), s=ROAD.but(start=0, end=2, skip=1)).count() == 0
    with pytest.raises(ValueError):
        scans.labelled_scans(spark, str(tmp_path / "scans"), str(tmp_path / "labels"), s=ROAD)
    o = np.zeros(2, scans.OBJECT_RECORD)
    o["x"] = [1.5, 2.5]
    (tmp_path / "objects/car.bin").write_bytes(o.tobytes())
    assert sorted(r["x"] for r in scans.read_objects(spark, str(tmp_path / "objects")).collect()) == [1.5, 2.5]
    stats = catalogue.stats(spark, SF)
    scans.write_intensity(stats, str(tmp_path / "dump"))
    assert scans.read_intensity(spark, str(tmp_path / "dump")).count() == stats.count()


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from scanweave.streaming.frames import stream_voxel_stats

    p = catalogue.objects(spark, SF).withColumn("ts", F.timestamp_seconds(F.col("frame_id")))
    p.write.parquet(str(tmp_path / "in"))
    stream = stream_voxel_stats(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), ROAD)
    q = stream.writeStream.format("memory").queryName("voxel_stream").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("voxel_stream").count() == catalogue.stats(spark, SF).count()
