"""Shapes, neighbours, calibration, the base frame, label transfer: against plain Python and NumPy."""

import collections
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanweave.config import ROAD, Settings
from scanweave.functions.geometry import axis3, eigenvalues3
from scanweave.operators import features, neighbours, planarity, scoring, segments, tracking, voxels
from scanweave.plans.tables import ranked


def cloud(spark, xyz, **more):
    pdf = pd.DataFrame(np.asarray(xyz, float), columns=["x", "y", "z"]).assign(frame_id=0, id=range(len(xyz)), **more)
    return spark.createDataFrame(pdf)


def test_eigenvalues_and_axes_against_numpy(spark):
    rng = np.random.default_rng(1)
    made = [np.diag(d).astype(float) for d in ((0, 0, 0), (1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1), (5, 0, 0), (5, 5, 0))]
    for _ in range(60):
        a = rng.normal(size=(4, 3)) * rng.uniform(0.01, 50, 3)
        made.append(np.cov(a.T, bias=True))
    rows = [(k, m[0, 0], m[0, 1], m[0, 2], m[1, 1], m[1, 2], m[2, 2]) for k, m in enumerate(map(np.asarray, made))]
    df = spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], "k int, xx double, xy double, xz double, yy double, yz double, zz double")
    for r in axis3(eigenvalues3(df), "e3").collect():
        m = made[r.k]
        values, vectors = np.linalg.eigh(m)
        assert np.allclose([r.e3, r.e2, r.e1], values, atol=1e-7 * max(1.0, values[2]))
        if values[1] - values[0] > 1e-3 * values[2]:
            assert abs(np.dot(vectors[:, 0], (r.nx, r.ny, r.nz))) > 1 - 1e-9
    empty = eigenvalues3(spark.createDataFrame([(None,) * 6], "xx double, xy double, xz double, yy double, yz double, zz double")).first()
    assert empty.e1 is None and empty.e3 is None


def test_eigen_features_of_a_line_a_plane_and_a_point(spark):
    line = [(0.1 * k, 0.2 * k, 0.3 * k) for k in range(30)]
    plane = [(i, j, 0.0) for i in range(6) for j in range(6)]
    rng = np.random.default_rng(2)
    ball = rng.normal(size=(4000, 3))
    df = cloud(spark, line, c="line").unionByName(cloud(spark, plane, c="plane")).unionByName(cloud(spark, ball, c="ball")).unionByName(cloud(spark, [(1, 2, 3)] * 4, c="point"))
    r = {x.c: x for x in features.eigen_features(features.moments(df.repartition(7), "c")).collect()}
    assert r["line"].linearity == pytest.approx(1) and r["line"].eigen_entropy == pytest.approx(0, abs=1e-6) and r["line"].omnivariance == 0
    assert r["plane"].planarity == pytest.approx(1) and r["plane"].eigen_entropy == pytest.approx(math.log(2)) and r["plane"].change_of_curvature == 0
    assert r["ball"].scattering > 0.9 and r["ball"].eigen_entropy == pytest.approx(math.log(3), abs=1e-3)
    assert r["point"].linearity is None and r["point"].n == 4


def test_principal_variance_turns_the_aggregate(spark):
    rng = np.random.default_rng(3)
    xyz = rng.normal(size=(200, 3)) * (3, 0.5, 1) + (20, 0, 0)
    turn = 0.7
    xyz[:, :2] = xyz[:, :2] @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    r = features.principal_variance(features.moments(cloud(spark, xyz), "frame_id")).first()
    angle = math.atan2(xyz[:, 1].mean(), xyz[:, 0].mean())
    along = xyz[:, 0] * math.cos(angle) + xyz[:, 1] * math.sin(angle)
    across = -xyz[:, 0] * math.sin(angle) + xyz[:, 1] * math.cos(angle)
    assert (r.radial_var, r.tangent_var) == pytest.approx((along.var(), across.var())) and r.principal_var == max(r.radial_var, r.tangent_var)


# ---- shape histograms


def plain_histogram(xyz, group, triples, seed):
    prime = 2147483647

    def draw(t, corner):
        first = (t * 7919 + corner * 104729 + group % prime * 31 + seed * 127 + 1) % prime
        return (first * 48271 % prime * 69621 + corner) % prime * 48271 % prime

    xyz = sorted(map(tuple, xyz))
    low, side = np.min(xyz, 0), float(max(np.ptp(xyz, axis=0))) or 1.0
    cell = lambda p: tuple(min(int(math.floor((v - m) / side * 64)), 63) for v, m in zip(p, low))
    full = set(map(cell, xyz))
    kind = lambda h: 0 if h == 8 else 1 if h == 0 else 2
    counts, sums = collections.Counter(), collections.Counter()

    def put(h, v):
        counts[h * 64 + min(int(math.floor(v * 64)), 63)] += 1
        sums[0 if h < 3 else 1 if h == 3 else 2 if h < 7 else 3] += 1

    for t in range(triples):
        p = [xyz[draw(t, k) % len(xyz)] for k in range(3)]
        d, hits = [], []
        for a, b in ((0, 1), (0, 2), (1, 2)):
            d.append(math.sqrt((p[a][0] - p[b][0]) ** 2 + ((p[a][1] - p[b][1]) ** 2 + (p[a][2] - p[b][2]) ** 2)))
            hits.append(sum(cell([u + (v - u) * ((k + 1) / 9) for u, v in zip(p[a], p[b])]) in full for k in range(8)))
        far = side * 3**0.5
        for h, v in zip(hits, d):
            put(kind(h), v / far)
            if kind(h) == 2:
                put(3, h / 8)
        half = sum(d) / 2
        put(4 + (0 if hits == [8, 8, 8] else 1 if sum(hits) == 0 else 2), math.sqrt(math.sqrt(max(0.0, half * (half - d[0]) * (half - d[1]) * (half - d[2])))) / far)
        if d[0] > 0 and d[1] > 0:
            put(7 + kind(hits[2]), math.acos(min(1.0, max(-1.0, (d[0] ** 2 + d[1] ** 2 - d[2] ** 2) / (2 * d[0] * d[1])))) / 3.141592653589793)
    return [counts[i] / sums[0 if i < 192 else 1 if i < 256 else 2 if i < 448 else 3] if counts[i] else 0.0 for i in range(640)]


def test_shape_histograms_against_plain_python_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    groups = {1: rng.normal(size=(50, 3)), 2: np.c_[rng.random((30, 2)), np.zeros(30)], 3: np.array([[1.0, 2, 3]] * 3), 4: rng.integers(0, 3, (20, 3)).astype(float)}
    rows = [(g, *map(float, p)) for g, xyz in groups.items() for p in xyz]
    df = spark.createDataFrame(rows, "g long, x double, y double, z double")
    seen = []
    for parts in (1, 5):
        found = {r.g: r.histogram for r in features.shape_histograms(df.repartition(parts), ["g"], F.col("g"), 60, 9).collect()}
        assert set(found) == set(groups)
        seen.append(found)
        for g, xyz in groups.items():
            want = plain_histogram(xyz.tolist(), g, 60, 9)
            assert sum(abs(a - b) > 1e-12 for a, b in zip(found[g], want)) == 0, g
    assert seen[0] == seen[1]
    ten = features.shape_histograms(df, ["g"], F.col("g"), 60, 9).select("g", features.folded(F.col("histogram")).alias("f"), features.joint(F.array(F.lit(1.0)), features.folded(F.col("histogram"))).alias("j")).collect()
    for r in ten:
        assert np.allclose(r.f, [sum(seen[0][r.g][j::10]) for j in range(10)]) and len(r.j) == 11


# ---- neighbours


@pytest.mark.parametrize("shape", ["ball", "clumps", "line", "few", "one place"])
def test_k_nearest_against_all_pairs(spark, shape):
    rng = np.random.default_rng(6)
    xyz = {
        "ball": rng.normal(size=(400, 3)), "clumps": np.r_[rng.normal(size=(200, 3)) * 0.01, rng.normal(size=(150, 3)) * 0.01 + 50, [[300.0, 0, 0]]],
        "line": np.c_[np.arange(120.0), np.zeros((120, 2))], "few": rng.random((4, 3)), "one place": np.zeros((30, 3)),
    }[shape].round(4)
    got = collections.defaultdict(dict)
    for r in neighbours.k_nearest(cloud(spark, xyz).repartition(3), 10, ["frame_id"], ["id"]).collect():
        got[r.id][r.rank] = r.near_id
    d = ((xyz[:, None, :] - xyz[None]) ** 2).sum(-1).round(9)
    for i in range(len(xyz)):
        want = np.lexsort((np.arange(len(xyz)), d[i]))[:10]
        found = [got[i][k] for k in sorted(got[i])]
        assert len(found) == len(want) and np.allclose(d[i][found], d[i][want]), (i, found, want)


def test_groups_do_not_meet_and_none_is_lost(spark):
    rng = np.random.default_rng(8)
    df = cloud(spark, rng.random((60, 3))).withColumn("frame_id", (F.col("id") % 3).cast("int"))
    near = neighbours.k_nearest(df, 10, ["frame_id"], ["id"])
    assert near.count() == 600 and near.where("id % 3 <> near_id % 3").count() == 0
    assert neighbours.k_nearest(df.limit(0), 10, ["frame_id"], ["id"]).count() == 0


def test_calibrated_intensities_against_numpy(spark):
    rng = np.random.default_rng(9)
    wall = np.c_[np.full(300, 8.0) + rng.normal(0, 1e-3, 300), rng.uniform(-6, 6, 300), rng.uniform(-1, 2, 300)].round(4)
    flat = np.c_[rng.uniform(2, 30, (300, 2)), rng.normal(-1.7, 1e-3, 300)].round(4)
    xyz = np.r_[wall, flat, [[0, 0, 0]]]
    intensity = rng.uniform(0, 300, len(xyz)).round(3)
    got = {r.id: r.intensity for r in neighbours.calibrated(cloud(spark, xyz, intensity=intensity), 10, 255.0, ["frame_id"], ["id"]).collect()}
    around = planarity.nearest(xyz, 10)
    for i, near in enumerate(around):
        m = np.cov(xyz[near].T, bias=True)
        values, vectors = np.linalg.eigh(m)
        cosine = 1.0
        if values[1] - values[0] > 1e-3 * values[2] and np.linalg.norm(xyz[i]) > 0:
            cosine = max(0.3, abs(vectors[:, 0] @ xyz[i]) / np.linalg.norm(xyz[i]))
        assert got[i] == pytest.approx(min(255.0, min(255.0, intensity[i]) / cosine), rel=1e-6)
    # the road is seen at a low angle: its intensities rise most
    assert np.mean([got[i] / max(min(255.0, intensity[i]), 1e-9) for i in range(300, 600)]) > np.mean([got[i] / max(min(255.0, intensity[i]), 1e-9) for i in range(300)])


# ---- the base frame


def test_base_fusion_against_plain_python(spark):
    rng = np.random.default_rng(11)
    s = ROAD.but(occupancy=0.3)
    points = [(f, c, *(np.array([10 + 1.1 * c, f * 0.1, -1.0]) + rng.uniform(-0.5, 0.5, 3) * (2.5 if f == 2 else 1, 1, 1)).tolist()) for f, clusters in ((0, range(6)), (1, range(0, 6, 2)), (2, range(7)), (3, range(5))) for c in clusters for _ in range(60)]
    df = voxels.binned(spark.createDataFrame(points, "frame_id int, c long, x double, y double, z double"), s)
    # a voxel belongs to the least cluster that has points in it
    found = df.groupBy("frame_id", "voxel").agg(F.min("c").alias("cluster_id"))
    pts = df.join(found, ["frame_id", "voxel"])
    base = tracking.base_frame(found).first()
    count = collections.Counter(r.frame_id for r in found.select("frame_id", "cluster_id").distinct().collect())
    assert (base.frame_id, base.clusters) == min(((f, n) for f, n in count.items()), key=lambda x: (x[1], -x[0]))
    assert tracking.base_frame(found.limit(0)).count() == 0
    fused = 0
    for f in (1, 3):
        chosen = found.where(F.col("frame_id").isin(f, 0, 2)) if f == 3 else found
        rows = pts.join(chosen.select("frame_id").distinct(), "frame_id")
        b = tracking.base_frame(chosen).first().frame_id
        cells = {r.voxel: r.cluster_id for r in chosen.collect() if r.frame_id == b}
        size = collections.Counter(cells.values())
        met = collections.defaultdict(set)
        for r in rows.collect():
            if r.frame_id != b and r.voxel in cells:
                met[r.frame_id, r.cluster_id].add(r.voxel)
        name = {c: c for c in size}
        for hit in met.values():
            per = collections.Counter(cells[v] for v in hit)
            if len(per) > 1:
                joined = {name[c] for c, n in per.items() if n / size[c] >= s.occupancy}
                name = {c: min(joined) if n in joined else n for c, n in name.items()}
        got = {r.cluster_id: r.fused_id for r in tracking.base_fusion(rows, chosen, s).collect()}
        assert got == name
        fused += sum(c != n for c, n in name.items())
    assert fused


# ---- labels, clusters, fusion


def test_transferred_labels_and_instances(spark):
    truth = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 252 | 1 << 16), (0, 1.0, 0.0, 0.0, 40), (0, 2.0, 0.0, 0.0, 252 | 2 << 16), (1, 0.0, 0.0, 0.0, 50)], "frame_id int, x double, y double, z double, label long")
    pts = spark.createDataFrame([(k, 0, x, 0.0, 0.0) for k, x in enumerate((0.1, 0.2, 0.9, 1.5, 1.9, 9.0))], "id long, frame_id int, x double, y double, z double")
    got = scoring.transferred_labels(pts, truth, 0.6, ["frame_id"], ["frame_id", "id"], [F.col("r_x")])
    assert {r.id: r.label & 65535 for r in got.collect()} == {0: 252, 1: 252, 2: 40, 3: 40, 4: 252}
    assert {r.id for r in scoring.without_class(got, 252).collect()} == {2, 3}
    assert [tuple(r)[:3] for r in scoring.instance_ids(got).collect()] == [(252, 3, 2)]
    many = spark.range(40000).select((F.lit(253) + F.shiftleft(F.col("id") % 9000, 16)).alias("label"))
    one = scoring.instance_ids(many).first()
    assert (one.n, one.ids) == (40000, 9000) and abs(one.about - 9000) < 0.15 * 9000


def test_ranked_rows_are_numbered_in_their_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), int(v)) for g, v in zip(rng.integers(0, 3, 300), rng.permutation(300))]
    got = {(r.g, r.v): r.n for r in ranked(spark.createDataFrame(rows, "g string, v long").repartition(6), ["g"], ["v"], "n").collect()}
    want = {(g, v): k for x in "012" for k, (g, v) in enumerate(sorted(r for r in rows if r[0] == x))}
    assert got == want


def plain_fusion(clusters, edges, iterations):
    """Greedy rounds by the rules alone: clusters in descending order of their first voxel; the largest name wins."""
    name = dict(clusters)  # voxel -> cluster
    first = {}
    for v, c in clusters.items():
        first[c] = min(first.get(c, v), v)
    for _ in range(iterations):
        claimed, fusions = set(), []
        for c in sorted(first, key=lambda c: -first[c]):
            if c in claimed:
                continue
            found = {name[v] for u, v in edges if name[u] == c} - claimed
            if len(found) > 1:
                claimed |= found
                fusions.append(sorted(found))
        for group in fusions:
            low = first[group[0]]
            for v, n in name.items():
                if n in group:
                    name[v] = group[-1]
            for n in group[:-1]:
                del first[n]
            first[group[-1]] = low
    return {clusters[v]: n for v, n in name.items()}


def test_intensity_fusion_against_plain_rules(spark):
    rng = np.random.default_rng(12)
    s = Settings(min_dis=0.0, max_dis=8.0, range_res=0.4, sector_res=6.0, azimuth_res=6.0, min_azimuth=-30.0, max_azimuth=30.0, intensity_diff=3.0, intensity_cov=4.0, iteration=3, search_c=2)
    rows = {(0, int(r), int(t), int(a)) for r, t, a in rng.integers([0, 0, 0], [s.range_num, 20, 5], (260, 3))}
    made = [(f, r, t, a, float(rng.integers(0, 12)), float(rng.integers(0, 6))) for f, r, t, a in sorted(rows)]
    v = spark.createDataFrame(made, "frame_id int, r_i long, s_i long, a_i long, i_mean double, i_var double")
    v = v.withColumn("voxel", voxels.voxel_key(F.col("r_i"), F.col("s_i"), F.col("a_i"), s))
    comp = voxels.voxel_components(v, s).collect()
    # components split further, so that there is something to fuse
    least = {}
    for r in comp:
        k = (r.cluster_id, r.voxel % 3)
        least[k] = min(least.get(k, r.voxel), r.voxel)
    clusters = {r.voxel: least[r.cluster_id, r.voxel % 3] for r in comp}
    found = spark.createDataFrame([(0, k, c) for k, c in clusters.items()], "frame_id int, voxel long, cluster_id long")
    edges = [(r.u, r.v) for r in segments.similar_edges(v, s).collect()]
    got = {r.cluster_id: r.fused_id for r in segments.intensity_fusion(v, found, s).collect()}
    want = plain_fusion(clusters, edges, s.iteration)
    assert got == want and len(set(got.values())) < len(got)


def test_planar_clusters_become_buildings(spark):
    rng = np.random.default_rng(13)
    wall = np.c_[rng.uniform(0, 12, 900), rng.normal(0, 0.002, 900) + 5.0, rng.uniform(-1, 3, 900)]
    wall[:, 1] += wall[:, 0] * 0.5
    crown = rng.uniform((0, 0, 0), (7, 7, 4), (700, 3))
    df = cloud(spark, np.r_[wall, crown]).withColumn("cluster_id", F.when(F.col("id") < 900, 1).otherwise(2).cast("long")).withColumn("voxel", F.col("id"))
    flat = {r.cluster_id: (r.planar, r.grown) for r in planarity.planarity(df).collect()}
    assert flat[1][0] and flat[1][1] > 800 and not flat[2][0]
    b = segments.cluster_boxes(df).join(planarity.planarity(df).select("cluster_id", "planar"), "cluster_id")
    assert {r.cluster_id: r.type for r in b.withColumn("type", segments.object_type(F.col("planar"), ROAD)).collect()} == {1: 0, 2: 1}


def test_normals_of_a_plane_and_region_growing_by_plain_rules():
    rng = np.random.default_rng(14)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    flat = np.c_[rng.uniform(0, 3, (200, 2)), np.zeros(200)] @ turn.T
    around = planarity.nearest(flat, 10)
    normal, curvature = planarity.normals(flat, around)
    assert (np.abs(normal @ turn[:, 2]) > 1 - 1e-9).all() and (curvature < 1e-12).all()
    # two walls that meet at a right angle, a bent strip and noise: regions by breadth-first search over the same rules
    corner = np.r_[np.c_[rng.uniform(0, 3, (150, 2)), np.zeros(150)], np.c_[np.zeros(150), rng.uniform(0, 3, (150, 2))], rng.uniform(4, 7, (60, 3))]
    around = planarity.nearest(corner, 10)
    normal, curvature = planarity.normals(corner, around)
    left, total = set(range(len(corner))), 0
    for seed in sorted(range(len(corner)), key=lambda i: curvature[i]):
        if seed not in left:
            continue
        left.discard(seed)
        stack, size = [seed], 1
        while stack:
            p = stack.pop()
            for q in around[p]:
                if q in left and abs(normal[q] @ normal[p]) >= math.cos(math.radians(10)):
                    left.discard(q)
                    size += 1
                    if curvature[q] < 1.2:
                        stack.append(q)
        total += size if size >= 20 else 0
    assert planarity.grown_points(corner) == total > 200
