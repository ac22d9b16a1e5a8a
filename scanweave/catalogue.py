"""Every query of the point-cloud engine by name, with DuckDB SQL for those that SQL can express.

The queries run over the synthetic scene of fixtures.py. Doubles are rounded to six places in both engines.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import BUILDING, DYNAMIC, GROUND, ROAD, TREE
from .fixtures import DUCK_POINTS, lineitem, points, poses, raw_points
from .functions import geometry as g
from .functions import labels as lb
from .operators import features, ground, neighbours, planarity, scoring, segments, spatial, tracking, voxels
from .plans import segmentation
from .plans.tables import shared_dir, staged
from .sources.frames import frames, write_frame_files
from .sources.scans import decoded_times, frame_slice, write_coloured
from .sources.scans import merged_pairs as scans_of_pairs

S = ROAD
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace(", 6)", " + 1e-9, 6)")
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six places; the small step keeps ties, and the sign of zero, from depending on the last bit of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# ---- shared stages ------------------------------------------------------------------------------------------------


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that do not lie on the ground."""
    return points(spark, sf_dir).where("sem <> 40")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.binned(objects(spark, sf_dir), S)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.voxel_stats(bins(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stats(), stored for all queries that start from voxels."""
    return staged("voxels", lineitem(spark, sf_dir), lambda: stats(spark, sf_dir))


def components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged("clusters", lineitem(spark, sf_dir), lambda: voxels.voxel_components(grid(spark, sf_dir), S))


def clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(components, binned points with their cluster)."""
    found = components_of(spark, sf_dir)
    return found, bins(spark, sf_dir).join(found, ["frame_id", "voxel"])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.cluster_boxes(clustered(spark, sf_dir)[1])


def typed_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, points, boxes with a type); tall clusters stand for planar ones, so that SQL can follow."""
    found, pts = clustered(spark, sf_dir)
    return found, pts, segments.cluster_boxes(pts).withColumn("type", segments.object_type(F.col("max_z") - F.col("min_z") > 3.0, S))


GEO = f"""pts as ({DUCK_POINTS}),
geo as (select *, sqrt(x*x + y*y) rng, case when x = 0 and y = 0 then 0 when y >= 0 then atan2(y, x)*180/pi() else (atan2(y, x) + 2*pi())*180/pi() end ang,
               atan2(z, sqrt(x*x + y*y))*180/pi() azi from pts)"""
VOX = f"""{GEO},
vox as (select *, a_i*21600 + r_i*300 + s_i voxel from (
  select *, cast(ceil((rng - 1.5::double)/0.4::double) - 1 as bigint) r_i, cast(ceil(ang/1.2::double) - 1 as bigint) s_i, cast(ceil((azi + 40)/2::double) - 1 as bigint) a_i
  from geo where rng between 1.5 and 30 and azi between -40 and 80 and sem <> 40) q)"""
AGG = f"""{VOX},
agg as (select frame_id, voxel, min(r_i) r_i, min(s_i) s_i, min(a_i) a_i, count(*) n, avg(refl) i_mean,
        (count(*)*sum(refl*refl) - sum(refl)*sum(refl))::double/(count(*)*count(*))::double i_var from vox group by frame_id, voxel)"""
AROUND = """select a.frame_id, a.voxel u, a.i_mean ui, b.voxel v, b.i_mean vi, b.i_var vv
from (select *, r_i + dr x, s_i + ds y, a_i + da z from agg cross join (select unnest(range(-{k}, {k} + 1)) dr) cross join (select unnest(range(-{k}, {k} + 1)) ds) cross join (select unnest(range(-{k}, {k} + 1)) da)
      where {k} = 1 or r_i <= 43.2 or (abs(dr) <= 1 and abs(ds) <= 1 and abs(da) <= 1)) a
join agg b on b.frame_id = a.frame_id and b.voxel = a.z*21600 + a.x*300 + a.y where a.x between 0 and 71 and a.y between 0 and 299 and a.z between 0 and 59"""
COMP = f"""recursive {AGG},
e0 as materialized ({AROUND.format(k=1)}),
e as materialized (select frame_id f, u, v from e0 union select frame_id, v, u from e0),
cc(f, v, l) using key (f, v) as (
  select frame_id, voxel, voxel from agg
  union
  (select e.f, e.v, min(cc.l) from cc join e on e.f = cc.f and e.u = cc.v join recurring.cc r on r.f = e.f and r.v = e.v where cc.l < r.l group by 1, 2)),
comp as materialized (select f frame_id, v voxel, l cluster_id from cc),
cp as materialized (select * from vox join comp using (frame_id, voxel))"""
BOX = f"""{COMP},
box as materialized (select frame_id, cluster_id, count(*) n_pts, count(distinct voxel) n_vox, min(x) min_x, max(x) max_x, min(y) min_y, max(y) max_y, min(z) min_z, max(z) max_z,
        avg(x) mean_x, avg(y) mean_y, avg(z) mean_z from cp group by 1, 2)"""
TYPED = f"""{BOX},
typed as (select *, case when (max_x - min_x)*(max_y - min_y) > 30 then case when max_z - min_z > 3 then 0 else 1 end
                         when min_z < -1.2::double and (max_x - min_x)*(max_y - min_y) < 30 and max_z < 0.8::double then 2 else 1 end type from box)"""
PAIRS = """pairs as (select frame_id, lead(frame_id) over (order by frame_id) next_frame from (select distinct frame_id from comp) qualify next_frame is not null),
matches as materialized (select h.frame_id, h.cluster_id, h.next_frame, c.cluster_id match_id, count(*) voxels
  from (select distinct cp.frame_id, cluster_id, next_frame, voxel from cp join pairs using (frame_id)) h join comp c on c.frame_id = h.next_frame and c.voxel = h.voxel group by 1, 2, 3, 4)"""


# ---- scalar functions, filters, projections -----------------------------------------------------------------------


@query(f"with {GEO} select frame_id, obj_id, scan_key, x_mm, y_mm, z_mm, round(rng, 6) rng, round(ang, 6) ang, round(azi, 6) azi, round(sqrt(x*x + y*y + z*z), 6) dist from geo")
def polar_geometry(spark, sf_dir):
    geo = voxels.with_geometry(points(spark, sf_dir))
    return geo.select("frame_id", "obj_id", "scan_key", "x_mm", "y_mm", "z_mm", r6("rng").alias("rng"), r6("ang").alias("ang"), r6("azi").alias("azi"), r6(g.distance(F.col("x"), F.col("y"), F.col("z"))).alias("dist"))


@query(f"with {VOX} select frame_id, obj_id, scan_key, x_mm, y_mm, z_mm, r_i, s_i, a_i, voxel from vox")
def polar_bins(spark, sf_dir):
    return bins(spark, sf_dir).select("frame_id", "obj_id", "scan_key", "x_mm", "y_mm", "z_mm", "r_i", "s_i", "a_i", "voxel")


@query(f"with {GEO} select frame_id, sem, count(*) n, sum(refl)::bigint refl from geo where rng between 1.5 and 30 and azi between -40 and 80 group by 1, 2")
def grid_window_filter(spark, sf_dir):
    return voxels.with_geometry(points(spark, sf_dir)).where(voxels.in_window(S)).groupBy("frame_id", "sem").agg(F.count("*").alias("n"), F.sum("refl").alias("refl"))


@query(f"with {GEO} select frame_id, obj_id, scan_key, x_mm, y_mm, z_mm from geo where not (rng between 1.5 and 30 and azi between -40 and 80)")
def out_of_grid_side(spark, sf_dir):
    return voxels.with_geometry(points(spark, sf_dir)).where(~voxels.in_window(S)).select("frame_id", "obj_id", "scan_key", "x_mm", "y_mm", "z_mm")


def packed_labels(spark, sf_dir):
    """Points with a packed label; every seventh object is unlabelled."""
    sem = F.when(F.col("obj_id") % 7 == 0, F.col("obj_id") % 2).otherwise(F.col("sem")).cast("long")
    return points(spark, sf_dir).withColumn("label", F.shiftleft(F.col("obj_id"), 16).bitwiseOR(sem))


PACKED = f"pts as ({DUCK_POINTS}), lab as (select *, (obj_id << 16) | cast(case when obj_id % 7 = 0 then obj_id % 2 else sem end as bigint) label from pts)"


@query(f"with {PACKED} select frame_id, label & 65535 sem, count(*) n from lab where (label & 65535) not in (0, 1) group by 1, 2")
def drop_unlabeled(spark, sf_dir):
    return packed_labels(spark, sf_dir).where(lb.labelled(F.col("label"))).groupBy("frame_id", lb.semantic(F.col("label")).alias("sem")).agg(F.count("*").alias("n"))


@query(f"with {PACKED} select label, label & 65535 sem, label >> 16 inst, count(*) n from lab group by label")
def label_split(spark, sf_dir):
    return packed_labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).select("label", lb.semantic(F.col("label")).alias("sem"), lb.instance(F.col("label")).alias("inst"), "n")


_COARSE = f"case when sem in {GROUND} then 40 when sem in {BUILDING} then 50 when sem in {TREE} then 70 else 0 end"


@query(f"with pts as ({DUCK_POINTS}) select frame_id, {_COARSE} class, count(*) n from pts group by 1, 2")
def coarse_class(spark, sf_dir):
    return points(spark, sf_dir).groupBy("frame_id", lb.coarse_class(F.col("sem")).alias("class")).agg(F.count("*").alias("n"))


@query(
    f"with pts as ({DUCK_POINTS}), c as (select {_COARSE} class, count(*) n from pts group by 1) "
    "select class, case class when 40 then 128 when 50 then 0 when 70 then 0 else 255 end r, case class when 40 then 128 when 70 then 255 else 0 end g, case class when 40 then 128 when 50 then 255 else 0 end b, class back, n from c"
)
def class_colour(spark, sf_dir):
    c = points(spark, sf_dir).groupBy(lb.coarse_class(F.col("sem")).alias("class")).agg(F.count("*").alias("n")).withColumn("c", lb.colour(F.col("class")))
    return c.select("class", "c.r", "c.g", "c.b", lb.class_of_colour(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"), "n")


@query(f"with pts as ({DUCK_POINTS}) select frame_id, count(*) n from pts where frame_id >= 1 and frame_id < 6 and (frame_id - 1) % 2 = 0 group by 1")
def frame_stride(spark, sf_dir):
    return frame_slice(points(spark, sf_dir), S.but(start=1, end=6, skip=2)).groupBy("frame_id").agg(F.count("*").alias("n"))


POSES = "poses as (select cast(i as int) frame_id, i*0.5::double px, i*-0.25::double py, 0.1::double*i pz, 0.01::double*i roll, -0.02::double*i pitch, 0.05::double*i yaw from range(7) t(i))"
ROT = f"""{POSES},
rot as (select *, cos(yaw)*cos(pitch) r0, cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll) r1, sin(yaw)*sin(roll) + cos(yaw)*sin(pitch)*cos(roll) r2,
  sin(yaw)*cos(pitch) r3, cos(yaw)*cos(roll) + sin(yaw)*sin(pitch)*sin(roll) r4, sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll) r5,
  -sin(pitch) r6, cos(pitch)*sin(roll) r7, cos(pitch)*cos(roll) r8 from poses)"""


def pose_columns() -> tuple[list[Column], list[Column]]:
    return g.rotation(F.col("roll"), F.col("pitch"), F.col("yaw")), [F.col("px"), F.col("py"), F.col("pz")]


@query(
    f"with pts as ({DUCK_POINTS}), {ROT} select frame_id, obj_id, scan_key, beam, round(r0*x + r1*y + r2*z + px, 6) wx, round(r3*x + r4*y + r5*z + py, 6) wy, round(r6*x + r7*y + r8*z + pz, 6) wz from pts join rot using (frame_id)"
)
def rigid_transform(spark, sf_dir):
    joined = points(spark, sf_dir).join(F.broadcast(poses(spark)), "frame_id")  # seven rows
    wx, wy, wz = g.apply(*pose_columns(), [F.col("x"), F.col("y"), F.col("z")])
    return joined.select("frame_id", "obj_id", "scan_key", "beam", r6(wx).alias("wx"), r6(wy).alias("wy"), r6(wz).alias("wz"))


@query(
    f"with {ROT} select frame_id, round(atan2(r7, r8), 6) roll, round(atan2(-r6, sqrt(r0*r0 + r3*r3)), 6) pitch, round(atan2(r3, r0), 6) yaw, "
    "round(sqrt(1 + r0 + r4 + r8)/2, 6) qw, round(sign(r3 - r1)*sqrt(greatest(0, 1 - r0 - r4 + r8))/2, 6) qz from rot"
)
def euler_from_matrix(spark, sf_dir):
    r, _ = pose_columns()
    q = g.quaternion(r)
    return poses(spark).select("frame_id", *(r6(c).alias(n) for c, n in zip(g.euler(r), ("roll", "pitch", "yaw"))), r6(q[3]).alias("qw"), r6(q[2]).alias("qz"))


@query(
    f"with {ROT}, n as (select *, lead(frame_id) over (order by frame_id) next_frame, lead(px) over w nx, lead(py) over w ny, lead(pz) over w nz from rot window w as (order by frame_id)) "
    "select frame_id, next_frame, round(r0*(nx - px) + r3*(ny - py) + r6*(nz - pz), 6) fx, round(r1*(nx - px) + r4*(ny - py) + r7*(nz - pz), 6) fy, round(r2*(nx - px) + r5*(ny - py) + r8*(nz - pz), 6) fz from n where next_frame is not null"
)
def relative_motion(spark, sf_dir):
    w = Window.orderBy("frame_id")  # one row per frame
    ahead = poses(spark).select("*", F.lead("frame_id").over(w).alias("next_frame"), *(F.lead(f"p{c}").over(w).alias(f"n{c}") for c in "xyz")).where("next_frame is not null")
    moved = g.apply(*g.invert(*pose_columns()), [F.col(f"n{c}") for c in "xyz"])
    return ahead.select("frame_id", "next_frame", *(r6(c).alias(n) for c, n in zip(moved, ("fx", "fy", "fz"))))


_TURNS = """e as (select vec_id, 6*embedding[1]::double roll, case when vec_id % 7 = 0 then pi()/2 else 3*embedding[2]::double end pitch, 6*embedding[3]::double yaw from embeddings where embedding is not null),
rot as (select *, cos(yaw)*cos(pitch) r0, cos(yaw)*sin(pitch)*sin(roll) - sin(yaw)*cos(roll) r1, sin(yaw)*sin(roll) + cos(yaw)*sin(pitch)*cos(roll) r2,
  sin(yaw)*cos(pitch) r3, cos(yaw)*cos(roll) + sin(yaw)*sin(pitch)*sin(roll) r4, sin(yaw)*sin(pitch)*cos(roll) - cos(yaw)*sin(roll) r5,
  -sin(pitch) r6, cos(pitch)*sin(roll) r7, cos(pitch)*cos(roll) r8 from e)"""


@query(
    f"with {_TURNS} select vec_id, round(case when sqrt(r0*r0 + r3*r3) < 1e-6 then atan2(-r5, r4) else atan2(r7, r8) end, 6) roll, round(atan2(-r6, sqrt(r0*r0 + r3*r3)), 6) pitch, round(case when sqrt(r0*r0 + r3*r3) < 1e-6 then 0 else atan2(r3, r0) end, 6) yaw, "
    "round(case when r7 < r5 then -1 else 1 end*sqrt(greatest(0, 1 + r0 - r4 - r8))/2, 5) qx, round(case when r2 < r6 then -1 else 1 end*sqrt(greatest(0, 1 - r0 + r4 - r8))/2, 5) qy, round(case when r3 < r1 then -1 else 1 end*sqrt(greatest(0, 1 - r0 - r4 + r8))/2, 5) qz, round(sqrt(greatest(0, 1 + r0 + r4 + r8))/2, 5) qw from rot"
)
def turns_of_vectors(spark, sf_dir):
    """Rotations made of vectors' first entries, back to angles and to quaternions; every seventh points straight up."""
    at = lambda k: F.col("embedding")[k].cast("double")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    r = g.rotation(6 * at(0), F.when(F.col("vec_id") % 7 == 0, F.lit(math.pi / 2)).otherwise(3 * at(1)), 6 * at(2))
    made = e.select("vec_id", *(c.alias(f"r{k}") for k, c in enumerate(r)))
    own = [F.col(f"r{k}") for k in range(9)]
    return made.select("vec_id", *(r6(c).alias(n) for c, n in zip(g.euler(own), ("roll", "pitch", "yaw"))), *(F.round(c, 5).alias(n) for c, n in zip(g.quaternion(own), ("qx", "qy", "qz", "qw"))))


# fixed values: the weights of the descriptor's places
_WEIGHTS = [0.5, 0.5, 0.2, 0.2, 0.2, 0.2, 0.2, 0.6, 0.2, 0.0]


@query(f"select a.vec_id a, b.vec_id b, round(list_sum(list_transform(range(1, 11), lambda i: {_WEIGHTS}[i]::double * abs(a.embedding[i]::double - b.embedding[i]::double))), 6) gap from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def descriptor_l1(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "a").select("a", "b", r6(g.weighted_l1(F.col("ea"), F.col("eb"), _WEIGHTS)).alias("gap"))


# ---- voxels -------------------------------------------------------------------------------------------------------


@query(f"with {AGG} select frame_id, voxel, r_i, s_i, a_i, n, round(i_mean, 6) i_mean, round(i_var, 6) i_var from agg")
def voxel_stats(spark, sf_dir):
    return stats(spark, sf_dir).withColumns({"i_mean": r6("i_mean"), "i_var": r6("i_var")})


@query(
    f"with {AGG} select frame_id, voxel, round((r_i*0.4::double + 1.5)*cos(radians(s_i*1.2::double)), 6) cx, round((r_i*0.4::double + 1.5)*sin(radians(s_i*1.2::double)), 6) cy, round((r_i*0.4::double + 1.5)*tan(radians(a_i*2::double - 40)), 6) cz from agg"
)
def voxel_corner(spark, sf_dir):
    return voxels.with_corner(grid(spark, sf_dir), S).select("frame_id", "voxel", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("cz").alias("cz"))


@query(
    f"with pts as ({DUCK_POINTS}), c as (select *, cast(floor(x/0.1::double) as bigint) gx, cast(floor(y/0.1::double) as bigint) gy, cast(floor(z/0.1::double) as bigint) gz from pts where sem <> 40), "
    "l as (select frame_id, gx, gy, gz, sem, count(*) k, sum(x) x, sum(y) y, sum(z) z, sum(refl) refl from c group by all) "
    "select frame_id, gx, gy, gz, cast(sum(k) as bigint) n, arg_min(sem, -k*1000 + sem) sem, round(sum(x)/sum(k), 6) x, round(sum(y)/sum(k), 6) y, round(sum(z)/sum(k), 6) z, round(sum(refl)/sum(k), 6) refl from l group by frame_id, gx, gy, gz"
)
def voxel_downsample(spark, sf_dir):
    return voxels.downsample(objects(spark, sf_dir), 0.1).select("frame_id", "gx", "gy", "gz", "n", "sem", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), r6("refl").alias("refl"))


@query(f"with {AGG} select frame_id, u, v from ({AROUND.format(k=1)})")
def neighbour_voxels(spark, sf_dir):
    return voxels.neighbour_edges(grid(spark, sf_dir), S).select("frame_id", "u", "v")


@query(f"with {AGG} select frame_id, u, v from ({AROUND.format(k=2)}) where vv <= 400 and abs(ui - vi) <= 20")
def similar_neighbours(spark, sf_dir):
    # the scene's reflectance has no spatial structure: wider limits than the preset's let some edges through
    return segments.similar_edges(grid(spark, sf_dir), S.but(intensity_cov=400.0, intensity_diff=20.0))


@query(f"with {COMP} select * from comp")
def components(spark, sf_dir):
    return components_of(spark, sf_dir)


@query(f"with {COMP}, f as (select frame_id, cluster_id, min(voxel) as first from comp group by 1, 2) select *, row_number() over (partition by frame_id order by first desc)::int place from f")
def cluster_order(spark, sf_dir):
    return segments.cluster_order(components_of(spark, sf_dir))


@query(
    f"with {AGG}, picked as (select frame_id, voxel from agg where n >= 2 union all select frame_id, voxel from agg where n >= 3) select v.frame_id, v.voxel, count(*) n, sum(refl)::bigint refl from vox v join picked using (frame_id, voxel) group by 1, 2"
)
def gathered_points(spark, sf_dir):
    """The points of listed voxels; those that are listed twice count twice."""
    full = grid(spark, sf_dir)
    listed = full.where("n >= 2").select("frame_id", "voxel").unionByName(full.where("n >= 3").select("frame_id", "voxel"))
    return segments.gathered(bins(spark, sf_dir), listed, ["frame_id", "voxel"]).groupBy("frame_id", "voxel").agg(F.count("*").alias("n"), F.sum("refl").alias("refl"))


# ---- clusters -----------------------------------------------------------------------------------------------------

_BOX_COLUMNS = ["frame_id", "cluster_id", "n_pts", "n_vox", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]


@query(f"with {BOX} select {', '.join(_BOX_COLUMNS)} from box")
def cluster_boxes(spark, sf_dir):
    return boxes(spark, sf_dir).select(*_BOX_COLUMNS)


@query(f"with {BOX} select frame_id, cluster_id, round(mean_x, 6) mean_x, round(mean_y, 6) mean_y, round(mean_z, 6) mean_z from box")
def cluster_centroids(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame_id", "cluster_id", *(r6(f"mean_{c}").alias(f"mean_{c}") for c in "xyz"))


@query(f"with {BOX} select frame_id, cluster_id, case when min_z > 0 then 'floating' when n_pts < 10 then 'small' when max_z - min_z < 0.2::double then 'flat' else 'kept' end reason, min_z > 0 floating, n_pts < 10 small from box")
def box_filter(spark, sf_dir):
    return boxes(spark, sf_dir).select("frame_id", "cluster_id", F.coalesce(segments.drop_reason(S), F.lit("kept")).alias("reason"), (F.col("min_z") > 0).alias("floating"), (F.col("n_pts") < S.to_be_class).alias("small"))


@query(f"with {BOX} select {', '.join(_BOX_COLUMNS)} from box where not (min_z > 0 or n_pts < 10 or max_z - min_z < 0.2::double)")
def kept_clusters(spark, sf_dir):
    return segments.kept_clusters(boxes(spark, sf_dir), S).select(*_BOX_COLUMNS)


@query(
    f"with {BOX}, a as (select *, case when max_x = 0 and max_y = 0 then 0 when max_y >= 0 then atan2(max_y, max_x)*180/pi() else (atan2(max_y, max_x) + 2*pi())*180/pi() end am, "
    "case when min_x = 0 and min_y = 0 then 0 when min_y >= 0 then atan2(min_y, min_x)*180/pi() else (atan2(min_y, min_x) + 2*pi())*180/pi() end an from box) "
    "select frame_id, cluster_id, 11::int size, round(max_z, 6) d7, round((max_x - min_x)*(max_y - min_y), 6) d8, round(abs(am - an), 6) d9, round(min_z, 6) d10, 6::double ones from a"
)
def descriptor(spark, sf_dir):
    d = segments.with_descriptor(boxes(spark, sf_dir))
    at = lambda k: r6(F.element_at("descriptor", k)).alias(f"d{k}")
    return d.select("frame_id", "cluster_id", F.size("descriptor").alias("size"), at(7), at(8), at(9), at(10), F.aggregate(F.slice("descriptor", 1, 6), F.lit(0.0), lambda a, b: a + b).alias("ones"))


@query(f"with {TYPED} select frame_id, cluster_id, type from typed")
def type_rule(spark, sf_dir):
    return typed_boxes(spark, sf_dir)[2].select("frame_id", "cluster_id", "type")


@query(
    f"with {TYPED}, s as (select *, case when n_pts % 3 = 0 then 1 else 0 end state from typed) select type, state, count(*) n, "
    "case when state = 1 then 255 when type = 0 then 139 when type = 1 then 162 end r, case when state = 1 then 0 when type = 0 then 90 when type = 1 then 205 end g, case when state = 1 then 0 when type = 0 then 0 when type = 1 then 90 end b from s group by 1, 2"
)
def object_colours(spark, sf_dir):
    # every third box stands for a moving one
    kinds = typed_boxes(spark, sf_dir)[2].groupBy("type", F.when(F.col("n_pts") % 3 == 0, 1).otherwise(0).alias("state")).agg(F.count("*").alias("n"))
    return kinds.withColumn("c", lb.object_colour(F.col("type"), F.col("state"))).select("type", "state", "n", "c.r", "c.g", "c.b")


# ---- tracking -----------------------------------------------------------------------------------------------------


@query(f"with {COMP}, {PAIRS} select * from pairs")
def frame_pairs(spark, sf_dir):
    return tracking.frame_pairs(grid(spark, sf_dir))


@query(f"with {COMP}, {PAIRS} select * from matches")
def overlap_matches(spark, sf_dir):
    found, pts = clustered(spark, sf_dir)
    return tracking.overlap_matches(pts, found, S).select("frame_id", "cluster_id", "next_frame", "match_id", "voxels")


@query(f"with {BOX}, {PAIRS} select m.frame_id, m.cluster_id, m.next_frame, m.match_id, m.voxels, round(m.voxels/b.n_vox, 6) ratio from matches m join box b on b.frame_id = m.next_frame and b.cluster_id = m.match_id")
def overlap_ratio(spark, sf_dir):
    found, pts = clustered(spark, sf_dir)
    return tracking.overlap_ratios(tracking.overlap_matches(pts, found, S), segments.cluster_boxes(pts)).select("frame_id", "cluster_id", "next_frame", "match_id", "voxels", r6("ratio").alias("ratio"))


@query(f"with {BOX}, {PAIRS} select b.frame_id, b.cluster_id, count(m.match_id) m from box b join pairs using (frame_id) left join matches m on m.frame_id = b.frame_id and m.cluster_id = b.cluster_id group by 1, 2")
def match_fanout(spark, sf_dir):
    found, pts = clustered(spark, sf_dir)
    return tracking.match_fanout(segments.cluster_boxes(pts), tracking.overlap_matches(pts, found, S))


@query(
    f"""with {COMP}, {PAIRS}, {ROT},
world as (select cp.frame_id, cp.cluster_id, next_frame, r0*x + r1*y + r2*z + px wx, r3*x + r4*y + r5*z + py wy, r6*x + r7*y + r8*z + pz wz from cp join pairs using (frame_id) join rot using (frame_id)),
moved as (select w.frame_id, cluster_id, next_frame, r0*(wx - px) + r3*(wy - py) + r6*(wz - pz) x, r1*(wx - px) + r4*(wy - py) + r7*(wz - pz) y, r2*(wx - px) + r5*(wy - py) + r8*(wz - pz) z from world w join rot on rot.frame_id = w.next_frame),
mgeo as (select *, sqrt(x*x + y*y) rng, case when x = 0 and y = 0 then 0 when y >= 0 then atan2(y, x)*180/pi() else (atan2(y, x) + 2*pi())*180/pi() end ang, atan2(z, sqrt(x*x + y*y))*180/pi() azi from moved),
mvox as (select distinct frame_id, cluster_id, next_frame, cast(ceil((azi + 40)/2::double) - 1 as bigint)*21600 + cast(ceil((rng - 1.5::double)/0.4::double) - 1 as bigint)*300 + cast(ceil(ang/1.2::double) - 1 as bigint) voxel
         from mgeo where rng between 1.5 and 30 and azi between -40 and 80)
select m.frame_id, m.cluster_id, m.next_frame, c.cluster_id match_id, count(*) voxels from mvox m join comp c on c.frame_id = m.next_frame and c.voxel = m.voxel group by 1, 2, 3, 4"""
)
def moved_matches(spark, sf_dir):
    """overlap_matches with the scanner's own motion taken out."""
    found, pts = clustered(spark, sf_dir)
    return tracking.overlap_matches(pts, found, S, poses(spark)).select("frame_id", "cluster_id", "next_frame", "match_id", "voxels")


@query(
    f"with {TYPED}, {PAIRS}, one as (select m.frame_id, m.cluster_id, count(*) k, max(m.voxels/t.n_vox) q, max(t.type) t from matches m join typed t on t.frame_id = m.next_frame and t.cluster_id = m.match_id group by 1, 2) "
    "select c.frame_id, c.cluster_id, coalesce(k, 0)::bigint m, case when coalesce(k, 0) = 0 then 1 when k > 1 then 0 when q < 0.4::double then case when t = 2 then 1 else 0 end when t = 2 then 0 else -1 end state "
    "from typed c join pairs using (frame_id) left join one o on o.frame_id = c.frame_id and o.cluster_id = c.cluster_id where c.type = 2"
)
def pair_state(spark, sf_dir):
    found, pts, typed = typed_boxes(spark, sf_dir)
    return tracking.pair_states(typed, tracking.overlap_matches(pts, found, S), S)


# ---- ground -------------------------------------------------------------------------------------------------------

CZM = f"""pts as ({DUCK_POINTS}),
p as (select *, sqrt(x*x + y*y) zr, case when y >= 0 then atan2(y, x) else atan2(y, x) + 2*pi() end zt from pts where z >= -1.8::double*1.73::double),
q as (select *, case when zr > 2.7 and zr <= 80 then case when zr < 12.3625 then 0 when zr < 22.025 then 1 when zr < 41.35 then 2 else 3 end end zone from p),
czm as (select *, case zone when 0 then least(trunc((zr - 2.7::double)/((12.3625::double - 2.7::double)/2)), 1) when 1 then least(trunc((zr - 12.3625::double)/((22.025::double - 12.3625::double)/4)), 3)
                     when 2 then least(trunc((zr - 22.025::double)/((41.35::double - 22.025::double)/4)), 3) when 3 then least(trunc((zr - 41.35::double)/((80::double - 41.35::double)/4)), 3) end::int ring,
        case zone when 0 then least(trunc(zt/(2*pi()/16)), 15) when 1 then least(trunc(zt/(2*pi()/32)), 31) when 2 then least(trunc(zt/(2*pi()/54)), 53) when 3 then least(trunc(zt/(2*pi()/32)), 31) end::int sector from q),
seeds as (select *, row_number() over (partition by frame_id, zone, ring, sector order by z, x, y) rank from czm where zone is not null and not (zone = 0 and z < -1.1::double*1.73::double) qualify rank <= 20)"""


def zoned(spark, sf_dir):
    return ground.with_zones(points(spark, sf_dir), S.sensor_height)


@query(f"with {CZM} select frame_id, obj_id, scan_key, beam, zone, ring, sector from czm")
def czm_bins(spark, sf_dir):
    return zoned(spark, sf_dir).select("frame_id", "obj_id", "scan_key", "beam", "zone", "ring", "sector")


@query(f"with {CZM} select frame_id, zone, ring, sector, rank::int rank, x_mm, y_mm, z_mm from seeds")
def lowest_seeds(spark, sf_dir):
    return ground.lowest_seeds(zoned(spark, sf_dir), S.sensor_height).select("frame_id", "zone", "ring", "sector", "rank", "x_mm", "y_mm", "z_mm")


@query(f"with {CZM} select frame_id, zone, ring, sector, round(avg(z), 6) lpr, count(*) seeds from seeds group by 1, 2, 3, 4")
def seed_height(spark, sf_dir):
    return ground.seed_heights(zoned(spark, sf_dir), S.sensor_height).withColumn("lpr", r6("lpr"))


@query(f"with {CZM} select frame_id, zone, ring, sector, count(*) n, count(*) > 10 fitted from czm where zone is not null group by 1, 2, 3, 4")
def patch_counts(spark, sf_dir):
    return zoned(spark, sf_dir).where("zone is not null").groupBy(*ground.PATCH).agg(F.count("*").alias("n"), (F.count("*") > ground.LEAST_POINTS).alias("fitted"))


@query()
def ground_split(spark, sf_dir):
    found = ground.ground_split(points(spark, sf_dir), S.sensor_height)
    return found.groupBy("frame_id", "status", (F.col("sem") == 40).alias("truly_ground")).agg(F.count("*").alias("n"))


@query()
def cluster_planarity(spark, sf_dir):
    found, pts = clustered(spark, sf_dir)
    large = segments.cluster_boxes(pts).where((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) > S.car_square).select("frame_id", "cluster_id")
    return planarity.planarity(pts.join(large, ["frame_id", "cluster_id"], "left_semi"))


@query()
def intensity_fusion(spark, sf_dir):
    return segments.intensity_fusion(grid(spark, sf_dir), components_of(spark, sf_dir), S.but(intensity_cov=400.0, intensity_diff=20.0))


@query()
def tracking_fold(spark, sf_dir):
    found, pts, typed = typed_boxes(spark, sf_dir)
    return tracking.tracking_fold(pts, found, typed, S)


@query()
def segmented_clusters(spark, sf_dir):
    """The whole chain from raw scans: ground, fusion, the box filter, types by planarity, states with the scanner's motion taken out."""
    done = segmentation.segment_scans(points(spark, sf_dir), S.but(intensity_cov=400.0, intensity_diff=5.0), poses(spark))
    return done.clusters.select("frame_id", "cluster_id", "n_pts", "n_vox", "drop_reason", "type", "planar", "state", "track_id")


# ---- shapes -------------------------------------------------------------------------------------------------------

_SPREAD = "count(*) n, avg(x) mean_x, avg(y) mean_y, covar_pop(x, x) xx, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, y) yy, covar_pop(y, z) yz, covar_pop(z, z) zz"


def _eigen_sql(source: str) -> str:
    """The eigenvalues of xx..zz by the closed form, as further columns of a table."""
    return f"""(select *, greatest(e3_, 3*q - e1 - e3_) e2, greatest(0, e3_) e3 from (select *, q + 2*p*cos(t) e1, q + 2*p*cos(t + 2*pi()/3) e3_ from
  (select *, case when p > 0 then acos(least(1, greatest(-1, det/(2*p*p*p)))) else acos(0) end/3 t from
    (select *, (xx - q)*((yy - q)*(zz - q) - yz*yz) - xy*(xy*(zz - q) - yz*xz) + xz*(xy*yz - (yy - q)*xz) det from
      (select *, sqrt(((xx - q)**2 + (yy - q)**2 + (zz - q)**2 + 2*(xy*xy + xz*xz + yz*yz))/6) p from (select *, (xx + yy + zz)/3 q from {source}) q1) q2) q3) q4) q5)"""


@query(
    f"with {COMP}, m as (select frame_id, cluster_id, {_SPREAD} from cp group by 1, 2 having count(*) >= 10), s as (select *, e1/(e1 + e2 + e3) a, e2/(e1 + e2 + e3) b, e3/(e1 + e2 + e3) c from {_eigen_sql('m')}) "
    "select frame_id, cluster_id, round((a - b)/a, 6) linearity, round((b - c)/a, 6) planarity, round(c/a, 6) scattering, round((a*b*c)**(1/3::double), 6) omnivariance, round((a - c)/a, 6) anisotropy, "
    "round(abs(a*ln(a) + b*ln(b) + c*ln(c)), 6) eigen_entropy, round(c, 6) change_of_curvature from s"
)
def eigen_features(spark, sf_dir):
    """Of all clusters that are large enough to be kept."""
    spread = features.moments(clustered(spark, sf_dir)[1], "frame_id", "cluster_id").where(F.col("n") >= S.to_be_class)
    return features.eigen_features(spread).select("frame_id", "cluster_id", *(r6(c).alias(c) for c in features.EIGEN))


@query(
    f"with {TYPED}, m as (select frame_id, cluster_id, {_SPREAD} from cp group by 1, 2 having count(*) >= 10), s as (select *, e1/(e1 + e2 + e3) a, e2/(e1 + e2 + e3) b, e3/(e1 + e2 + e3) c from {_eigen_sql('m')}) "
    "select frame_id, cluster_id, round((a - b)/a/288.9::double, 6) v1, round(c/a/2889.9::double, 6) v3, round(abs(a*ln(a) + b*ln(b) + c*ln(c))/0.956129::double, 6) v6, round(max_z, 6) v7, round(min_z, 6) v10, type::double v11 from s join typed using (frame_id, cluster_id)"
)
def full_descriptor(spark, sf_dir):
    """All eleven places filled: eigen features over their maxima, the box's values, and the type in the last."""
    _, pts, typed = typed_boxes(spark, sf_dir)
    spread = features.eigen_features(features.moments(pts, "frame_id", "cluster_id").where(F.col("n") >= S.to_be_class))
    d = typed.join(spread.select("frame_id", "cluster_id", *features.EIGEN), ["frame_id", "cluster_id"]).withColumn("d", features.descriptor(typed, S))
    return d.select("frame_id", "cluster_id", *(r6(F.element_at("d", k)).alias(f"v{k}") for k in (1, 3, 6, 7, 10)), F.element_at("d", 11).alias("v11"))


@query(
    f"with {CZM}, m as (select frame_id, zone, ring, sector, {_SPREAD} from czm where zone is not null group by 1, 2, 3, 4 having count(*) > 10), t as (select *, cos(atan2(mean_y, mean_x)) c, sin(atan2(mean_y, mean_x)) s from m) "
    "select frame_id, zone, ring, sector, n, round(c*c*xx + s*s*yy + 2*c*s*xy, 6) radial_var, round(s*s*xx + c*c*yy - 2*c*s*xy, 6) tangent_var, round(greatest(c*c*xx + s*s*yy + 2*c*s*xy, s*s*xx + c*c*yy - 2*c*s*xy), 6) principal_var from t"
)
def patch_variance(spark, sf_dir):
    """Spread along and across the radius of all ground patches that are fitted."""
    spread = features.moments(zoned(spark, sf_dir).where("zone is not null"), *ground.PATCH).where(F.col("n") > ground.LEAST_POINTS)
    return features.principal_variance(spread).select(*ground.PATCH, "n", *(r6(c).alias(c) for c in ("radial_var", "tangent_var", "principal_var")))


@query()
def shape_histogram(spark, sf_dir):
    """The ten folded shares of sampled triples of all clusters that are kept, after the eleven values of their descriptors."""
    pts = clustered(spark, sf_dir)[1]
    spread = features.eigen_features(features.moments(pts, "frame_id", "cluster_id").where(F.col("n") >= S.to_be_class))
    large = pts.join(spread.select("frame_id", "cluster_id"), ["frame_id", "cluster_id"], "left_semi")
    shapes = features.shape_histograms(large, ["frame_id", "cluster_id"], F.col("frame_id").cast("long") * (1 << 24) + F.col("cluster_id"))
    d = boxes(spark, sf_dir).join(spread.select("frame_id", "cluster_id", *features.EIGEN), ["frame_id", "cluster_id"]).withColumn("d", features.descriptor(boxes(spark, sf_dir), S))
    joined = shapes.join(d.select("frame_id", "cluster_id", "d"), ["frame_id", "cluster_id"])
    return joined.select("frame_id", "cluster_id", F.transform(features.joint(F.col("d"), features.folded(F.col("histogram"))), r6).alias("values"))


def scan_places(spark, sf_dir) -> DataFrame:
    """Distinct places of whole scans, ground included, with the mean of their intensities."""
    return staged("places", lineitem(spark, sf_dir), lambda: raw_points(spark, sf_dir).groupBy("frame_id", "x_mm", "y_mm", "z_mm").agg(F.avg("refl").alias("intensity")))


_TEN = "arg_min(struct_pack(bx := bx, by_ := by_, bz := bz, d2 := d2), (d2, bx, by_, bz), 10)"
PLACES = f"""pts as ({DUCK_POINTS}), pl as materialized (select frame_id, x_mm, y_mm, z_mm, x, y, z, avg(refl) intensity from pts group by all),
pairs9 as (select a.frame_id, a.x_mm, a.y_mm, a.z_mm, b.x_mm bx, b.y_mm by_, b.z_mm bz, (a.x_mm - b.x_mm)**2 + (a.y_mm - b.y_mm)**2 + (a.z_mm - b.z_mm)**2 d2
  from (select *, unnest([-1, 0, 1]) + floor(y_mm/4000) ky from (select *, unnest([-1, 0, 1]) + floor(x_mm/4000) kx from pl)) a
  join (select *, floor(x_mm/4000) kx, floor(y_mm/4000) ky from pl) b using (frame_id, kx, ky)),
close as materialized (select frame_id, x_mm, y_mm, z_mm, {_TEN} l from pairs9 group by 1, 2, 3, 4),
settled as materialized (select * from close where len(l) = 10 and l[10].d2 <= 16e6),
pairs as (select a.*, b.x_mm bx, b.y_mm by_, b.z_mm bz, (a.x_mm - b.x_mm)**2 + (a.y_mm - b.y_mm)**2 + (a.z_mm - b.z_mm)**2 d2
  from (select frame_id, x_mm, y_mm, z_mm from pl except select frame_id, x_mm, y_mm, z_mm from settled) a join pl b using (frame_id)),
tens as materialized (select frame_id, x_mm, y_mm, z_mm, unnest(l) near from (select * from settled union all select frame_id, x_mm, y_mm, z_mm, {_TEN} from pairs group by 1, 2, 3, 4))"""
_PLACE = ["x_mm", "y_mm", "z_mm"]


@query(f"with {PLACES} select frame_id, x_mm, y_mm, z_mm, count(*) n, max((x_mm - near.bx)**2 + (y_mm - near.by_)**2 + (z_mm - near.bz)**2)::double d2, sum(near.bx)::bigint sx, sum(near.by_)::bigint sy, sum(near.bz)::bigint sz from tens group by 1, 2, 3, 4")
def ten_nearest(spark, sf_dir):
    """The ten nearest places of every place of whole scans; in millimetres, so that distances are exact."""
    at = scan_places(spark, sf_dir).select("frame_id", *_PLACE, *(F.col(f"{c}_mm").cast("double").alias(c) for c in "xyz"))
    near = neighbours.k_spreads(at, S.search_num, ["frame_id"], _PLACE)
    return near.select("frame_id", *_PLACE, "n", "d2", *(F.col(f"sum_{c}").cast("long").alias(f"s{c}") for c in "xyz"))


@query(
    f"""with {PLACES}, m as (select t.frame_id, t.x_mm, t.y_mm, t.z_mm, {_SPREAD.replace("(x", "(b.x").replace("(y", "(b.y").replace("(z", "(b.z").replace(", x)", ", b.x)").replace(", y)", ", b.y)").replace(", z)", ", b.z)")}
  from tens t join pl b on b.frame_id = t.frame_id and b.x_mm = t.near.bx and b.y_mm = t.near.by_ and b.z_mm = t.near.bz group by 1, 2, 3, 4),
c as (select *, [xy*yz - xz*(yy - e3), xz*xy - (xx - e3)*yz, (xx - e3)*(yy - e3) - xy*xy] c1, [xy*(zz - e3) - xz*yz, xz*xz - (xx - e3)*(zz - e3), (xx - e3)*yz - xy*xz] c2,
        [(yy - e3)*(zz - e3) - yz*yz, yz*xz - xy*(zz - e3), xy*yz - (yy - e3)*xz] c3 from {_eigen_sql("m")}),
l as (select *, list_sum(list_transform(c1, lambda v: v*v)) l1, list_sum(list_transform(c2, lambda v: v*v)) l2, list_sum(list_transform(c3, lambda v: v*v)) l3 from c),
w as (select *, case when l1 >= l2 and l1 >= l3 then c1 when l2 >= l3 then c2 else c3 end w, greatest(l1, l2, l3) lw, e2 - e3 > 1e-3*e1 sure from l),
f as (select pl.*, case when sure and lw > 0 and x*x + y*y + z*z > 0 then greatest(0.3::double, abs(w[1]*x + w[2]*y + w[3]*z)/sqrt(lw)/sqrt(x*x + y*y + z*z)) else 1 end cosine from pl join w using (frame_id, x_mm, y_mm, z_mm))
select frame_id, x_mm, y_mm, z_mm, round(least(255, least(255, intensity)/cosine) + 1e-7, 4) intensity from f"""
)
def intensity_calibration(spark, sf_dir):
    """Intensities of whole scans over the cosine of the incidence angle, from normals of ten neighbours; in millimetres, so that
    equal distances are equal."""
    at = scan_places(spark, sf_dir).select("frame_id", *(F.col(f"{c}_mm").cast("double").alias(c) for c in "xyz"), "intensity")
    found = neighbours.calibrated(at, S.search_num, S.max_intensity, ["frame_id"], list("xyz"))
    return found.select("frame_id", *(F.col(c).cast("long").alias(f"{c}_mm") for c in "xyz"), F.round(F.col("intensity") + 1e-7, 4).alias("intensity"))


# ---- the base frame ------------------------------------------------------------------------------------------------

_BASE_SQL = "base as (select frame_id, n clusters from (select frame_id, count(distinct cluster_id) n from comp group by 1) order by n, frame_id desc limit 1)"


@query(f"with {COMP}, {_BASE_SQL} select * from base")
def base_frame(spark, sf_dir):
    return tracking.base_frame(components_of(spark, sf_dir))


@query(
    f"""with {COMP}, {_BASE_SQL}, {ROT}, b as (select rot.* from rot join base using (frame_id)),
world as (select cp.frame_id, cp.cluster_id, r0*x + r1*y + r2*z + px wx, r3*x + r4*y + r5*z + py wy, r6*x + r7*y + r8*z + pz wz from cp join rot using (frame_id) where frame_id not in (select frame_id from base)),
moved as (select w.frame_id, cluster_id, r0*(wx - px) + r3*(wy - py) + r6*(wz - pz) x, r1*(wx - px) + r4*(wy - py) + r7*(wz - pz) y, r2*(wx - px) + r5*(wy - py) + r8*(wz - pz) z from world w, b),
mgeo as (select *, sqrt(x*x + y*y) rng, case when x = 0 and y = 0 then 0 when y >= 0 then atan2(y, x)*180/pi() else (atan2(y, x) + 2*pi())*180/pi() end ang, atan2(z, sqrt(x*x + y*y))*180/pi() azi from moved),
mvox as (select distinct frame_id, cluster_id, cast(ceil((azi + 40)/2::double) - 1 as bigint)*21600 + cast(ceil((rng - 1.5::double)/0.4::double) - 1 as bigint)*300 + cast(ceil(ang/1.2::double) - 1 as bigint) voxel
         from mgeo where rng between 1.5 and 30 and azi between -40 and 80),
own as (select comp.* from comp join base using (frame_id)), sizes as (select cluster_id, count(*) n from own group by 1),
met as (select m.frame_id, m.cluster_id, o.cluster_id match_id, count(*)/any_value(s.n) ratio from mvox m join own o using (voxel) join sizes s on s.cluster_id = o.cluster_id group by 1, 2, 3),
several as (select frame_id, cluster_id, list(match_id) filter (ratio >= 0.1) ids from met group by 1, 2 having count(*) > 1 and count(*) filter (ratio >= 0.1) > 1),
links as materialized (select distinct a, b from (select unnest(ids) a, ids from several) q, unnest(ids) u(b)),
cc0(c, l) using key (c) as (select cluster_id, cluster_id from sizes union (select k.b, min(cc0.l) from cc0 join links k on k.a = cc0.c join recurring.cc0 r on r.c = k.b where cc0.l < r.l group by 1))
select base.frame_id, c cluster_id, l fused_id from cc0, base"""
)
def base_fusion(spark, sf_dir):
    """Clusters of the base frame that clusters of other frames join; a tenth of their voxels is enough in this scene."""
    found, pts = clustered(spark, sf_dir)
    return tracking.base_fusion(pts, found, S.but(occupancy=0.1), poses(spark))


# ---- spatial joins ------------------------------------------------------------------------------------------------

_AT = ["frame_id", "x_mm", "y_mm", "z_mm"]


def clouds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two clouds of distinct places: points of even scans, and of odd ones."""
    p = objects(spark, sf_dir).groupBy(*_AT, "x", "y", "z", (F.col("scan_key") % 2).alias("odd")).agg(F.count("*").alias("weight"), F.min("sem").alias("sem"))
    return p.where("odd = 0").drop("odd"), p.where("odd = 1").drop("odd")


CLOUDS = f"""pts as ({DUCK_POINTS}),
c as (select frame_id, x_mm, y_mm, z_mm, scan_key % 2 odd, count(*) weight, min(sem) sem from pts where sem <> 40 group by all),
a as (select * from c where odd = 0), b as (select * from c where odd = 1),
near as (select a.frame_id, a.x_mm, a.y_mm, a.z_mm, a.sem, b.x_mm bx, b.y_mm by_, b.z_mm bz, b.sem bsem, (a.x_mm - b.x_mm)**2 + (a.y_mm - b.y_mm)**2 + (a.z_mm - b.z_mm)**2 d2 from
   (select *, unnest([floor(x_mm/500) - 1, floor(x_mm/500), floor(x_mm/500) + 1]) k from a) a join (select *, floor(x_mm/500) k from b) b on a.frame_id = b.frame_id and a.k = b.k where abs(a.y_mm - b.y_mm) <= 500)"""


def places(df: DataFrame) -> DataFrame:
    """In millimetres, so that distances are exact."""
    return df.withColumns({c: F.col(f"{c}_mm").cast("double") for c in "xyz"}).select(*_AT, "x", "y", "z", "weight", "sem")


def _order() -> list[Column]:
    """Settles equal distances."""
    return [F.col("r_x"), F.col("r_y"), F.col("r_z")]


@query(f"with {CLOUDS} select frame_id, x_mm, y_mm, z_mm, min(d2)::double d2, (arg_min(struct_pack(x := bx, y := by_, z := bz), (d2, bx, by_, bz))).x near_x from near where d2 <= 250000 group by 1, 2, 3, 4")
def nn_join(spark, sf_dir):
    a, b = clouds(spark, sf_dir)
    found = spatial.nearest(places(a), places(b), 500.0, ["frame_id"], _AT, _order())
    return found.select(*_AT, F.col("near.d2").alias("d2"), F.col("near.r_x_mm").alias("near_x"))


@query(f"with {CLOUDS} select distinct frame_id, x_mm, y_mm, z_mm from near where d2 <= 22500")
def radius_semi(spark, sf_dir):
    a, b = clouds(spark, sf_dir)
    return spatial.within(places(a), places(b), 150.0, ["frame_id"], _AT).select(*_AT)


@query(f"with {CLOUDS} select frame_id, x_mm, y_mm, z_mm from a except select frame_id, x_mm, y_mm, z_mm from near where d2 <= 22500")
def radius_anti(spark, sf_dir):
    a, b = clouds(spark, sf_dir)
    return spatial.beyond(places(a), places(b), 150.0, ["frame_id"], _AT).select(*_AT)


@query(
    f"with {CLOUDS}, chosen as (select frame_id, bx, by_, bz, arg_min(struct_pack(x := x_mm, y := y_mm, z := z_mm), (d2, x_mm, y_mm, z_mm)) n from near where d2 <= 250000 group by 1, 2, 3, 4) "
    "select frame_id, x_mm, y_mm, z_mm from a except select frame_id, n.x, n.y, n.z from chosen"
)
def complement_cloud(spark, sf_dir):
    a, b = clouds(spark, sf_dir)
    return spatial.complement(places(a), places(b), 500.0, ["frame_id"], _AT).select(*_AT)


# ---- scores -------------------------------------------------------------------------------------------------------


def estimate_of(p: DataFrame) -> DataFrame:
    """An estimate that lost most points of movers, and a few others."""
    return p.where(~(((F.col("sem") == 252) & (F.col("beam") % 4 != 0)) | ((F.col("sem") != 252) & (F.col("beam") % 50 == 0))))


ESTIMATE = f"pts as ({DUCK_POINTS}), est as (select * from pts where not ((sem = 252 and beam % 4 <> 0) or (sem <> 252 and beam % 50 = 0)))"


@query(
    f"with {ESTIMATE}, u as (select 'truth' cloud, sem from pts union all select 'estimate', sem from est) "
    "select cloud, count(*) filter (sem not between 252 and 259) n_static, count(*) filter (sem between 252 and 259) n_dynamic, count(*) n_total, round(count(*) filter (sem between 252 and 259)*100.0::double/nullif(count(*) filter (sem not between 252 and 259), 0), 6) percentage from u group by 1"
)
def static_dynamic_counts(spark, sf_dir):
    p = points(spark, sf_dir)
    both = scoring.static_and_dynamic(p).withColumn("cloud", F.lit("truth")).unionByName(scoring.static_and_dynamic(estimate_of(p)).withColumn("cloud", F.lit("estimate")))
    return both.withColumn("percentage", r6("percentage"))


@query(
    f"with {ESTIMATE} select sem::int sem, (select count(*) from pts where pts.sem = c.sem) n_truth, (select count(*) from est where est.sem = c.sem) n_estimate, "
    f"round(((select count(*) from pts where pts.sem = c.sem) - (select count(*) from est where est.sem = c.sem))*100.0::double/nullif((select count(*) from pts where pts.sem = c.sem), 0), 6) rejection from (select unnest({list(DYNAMIC)}) sem) c"
)
def class_rejection(spark, sf_dir):
    p = points(spark, sf_dir)
    return scoring.class_rejection(p, estimate_of(p)).withColumn("rejection", r6("rejection"))


@query(
    f"with {ESTIMATE}, n as (select (select count(*) from pts where sem between 252 and 259) d, (select count(*) from pts) t, (select count(*) from est where sem between 252 and 259) e, (select count(*) from est) u) "
    "select round((d - e)*1.0::double/nullif(t - u, 0), 6) as precision, round((d - e)*1.0::double/nullif(d, 0), 6) recall from n"
)
def count_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    return scoring.count_scores(p, estimate_of(p)).select(r6("precision").alias("precision"), r6("recall").alias("recall"))


@query(
    f"with {ESTIMATE} select case when sem between 252 and 259 then 255 else 205 end r, case when sem between 252 and 259 then 0 else 192 end g, case when sem between 252 and 259 then 0 else 176 end b, count(*) n from est group by 1, 2, 3"
)
def residue_colours(spark, sf_dir):
    left = estimate_of(points(spark, sf_dir)).withColumn("c", lb.residue_colour(F.col("sem")))
    return left.groupBy("c.r", "c.g", "c.b").agg(F.count("*").alias("n"))


def matched(spark, sf_dir, radius: float) -> DataFrame:
    """Distinct labelled places with the label of the nearest estimated place in reach."""
    p = points(spark, sf_dir)
    at = lambda df: df.groupBy(*_AT, "sem").agg(F.count("*").alias("weight"))
    truth, est = places(at(p)), places(at(estimate_of(p)).groupBy(*_AT).agg(F.sum("weight").alias("weight"), F.min("sem").alias("sem")))
    near = spatial.with_nearest(truth, est, radius, ["frame_id"], [*_AT, "sem"], _order())
    return near.select(*_AT, "sem", "weight", F.col("near.r_sem").alias("near_sem"), F.col("near.d2").alias("d2"))


MATCHED = """t as (select frame_id, x_mm, y_mm, z_mm, sem, count(*) weight from pts group by all), s as (select frame_id, x_mm, y_mm, z_mm, min(sem) sem from est group by all),
near as (select a.frame_id, a.x_mm, a.y_mm, a.z_mm, a.sem, b.sem bsem, b.x_mm bx, b.y_mm by_, b.z_mm bz, (a.x_mm - b.x_mm)**2 + (a.y_mm - b.y_mm)**2 + (a.z_mm - b.z_mm)**2 d2 from
   (select *, unnest([floor(x_mm/800) - 1, floor(x_mm/800), floor(x_mm/800) + 1]) k from t) a join (select *, floor(x_mm/800) k from s) b on a.frame_id = b.frame_id and a.k = b.k where abs(a.y_mm - b.y_mm) <= 800),
m as (select frame_id, x_mm, y_mm, z_mm, sem, arg_min(bsem, (d2, bx, by_, bz)) near_sem from near where d2 <= {d2} group by 1, 2, 3, 4, 5),
matched as (select t.*, near_sem from t left join m using (frame_id, x_mm, y_mm, z_mm, sem))"""


@query(
    f"with {ESTIMATE}, {MATCHED.format(d2='173.2050807568877::double**2').replace('where d2 <=', 'where d2 <')}, o as (select sum(weight) filter (sem not between 252 and 259) ns, sum(weight) filter (sem between 252 and 259) nd, "
    "coalesce(sum(weight) filter (sem not between 252 and 259 and near_sem not between 252 and 259), 0) ks, coalesce(sum(weight) filter (sem between 252 and 259 and near_sem between 252 and 259), 0) kd from matched), "
    "r as (select *, ks*100.0::double/ns pr, (nd - kd)*100.0::double/nd rr from o) select ns::bigint n_static, nd::bigint n_dynamic, ks::bigint kept_static, kd::bigint kept_dynamic, round(pr, 6) pr, round(rr, 6) rr, round(2*(pr/100)*(rr/100)/((pr + rr)/100), 6) f1 from r"
)
def preservation_scores(spark, sf_dir):
    reach = 1000 * scoring.inlier_distance(0.2)
    near = matched(spark, sf_dir, reach)
    # a place at the very distance is none
    found = scoring.preservation(near.withColumn("near_sem", F.when(F.col("d2") < reach * reach, F.col("near_sem"))))
    return found.withColumns({c: r6(c) for c in ("pr", "rr", "f1")})


@query(
    f"with {ESTIMATE}, {MATCHED.format(d2='100').replace('where d2 <=', 'where d2 <')} select sum(weight)::bigint n_points, coalesce(sum(weight) filter (near_sem is not null), 0)::bigint preserved, "
    "coalesce(sum(weight) filter (sem not between 252 and 259 and near_sem not between 252 and 259), 0)::bigint static_in_both from matched"
)
def exact_inliers(spark, sf_dir):
    """Points that an estimate has at their very place, a centimetre at most, and those static in both."""
    reach = 1000 * scoring.SAME_POINT
    near = matched(spark, sf_dir, reach)
    return scoring.exact_inliers(near.withColumn("near_sem", F.when(F.col("d2") < reach * reach, F.col("near_sem"))))


@query(
    f"with {ESTIMATE}, {MATCHED.format(d2=500000)}, k as (select weight, {_COARSE} class, {_COARSE.replace('sem in', 'near_sem in')} near, near_sem from matched) "
    "select class, sum(weight)::bigint n, coalesce(sum(weight) filter (near_sem is not null and (class = near or (class in (50, 70) and near in (50, 70)))), 0)::bigint hits, "
    "round(coalesce(sum(weight) filter (near_sem is not null and (class = near or (class in (50, 70) and near in (50, 70)))), 0)*100.0::double/sum(weight), 6) recall from k group by 1"
)
def class_recall(spark, sf_dir):
    own, near = lb.coarse_class(F.col("sem")), lb.coarse_class(F.col("near_sem"))
    found = matched(spark, sf_dir, 500000**0.5).withColumn("class", own).withColumn("hit", F.when(F.col("near_sem").isNotNull() & scoring.alike(own, near), F.col("weight")).otherwise(0))
    return found.groupBy("class").agg(F.sum("weight").alias("n"), F.sum("hit").alias("hits")).withColumn("recall", r6(F.col("hits") * 100.0 / F.col("n")))


@query(
    f"""with {CLOUDS}, s as (select * from b where sem <> 252), d as (select * from b where sem = 252),
w as (select a.*, case when sem <> 252 then 'static' else 'dynamic' end predicted from a),
q as (select w.*, exists(select 1 from near n where n.frame_id = w.frame_id and n.x_mm = w.x_mm and n.y_mm = w.y_mm and n.z_mm = w.z_mm and n.bsem <> 252 and n.d2 <= 22500) s15,
  exists(select 1 from near n where n.frame_id = w.frame_id and n.x_mm = w.x_mm and n.y_mm = w.y_mm and n.z_mm = w.z_mm and n.bsem = 252 and n.d2 <= 22500) d15,
  exists(select 1 from near n where n.frame_id = w.frame_id and n.x_mm = w.x_mm and n.y_mm = w.y_mm and n.z_mm = w.z_mm and n.bsem <> 252 and n.d2 <= 10000) s10,
  exists(select 1 from near n where n.frame_id = w.frame_id and n.x_mm = w.x_mm and n.y_mm = w.y_mm and n.z_mm = w.z_mm and n.bsem = 252 and n.d2 <= 10000) d10 from w)
select predicted, actual, count(*) places, sum(weight)::bigint n from (select *, case when predicted = 'static' then case when s15 then 'static' when d10 then 'dynamic' end else case when d15 then 'dynamic' when s10 then 'static' end end actual from q) z
where actual is not null group by 1, 2"""
)
def confusion_map(spark, sf_dir):
    a, b = clouds(spark, sf_dir)
    seen, right = places(a), places(b)
    # the nearest place that stands, and the nearest that moves, tell all that is asked of those in reach
    for name, moving in (("s", F.col("sem") != 252), ("d", F.col("sem") == 252)):
        near = spatial.with_near(seen, right.where(moving), 150.0, ["frame_id"], carry=[]).withColumn(name, F.col("near.d2")).drop("near")
        seen = near.withColumns({f"{name}15": F.col(name).isNotNull(), f"{name}10": F.coalesce(F.col(name) <= 10000, F.lit(False))}).drop(name)
    static = F.col("sem") != 252
    actual = F.when(static, F.when(F.col("s15"), "static").when(F.col("d10"), "dynamic")).otherwise(F.when(F.col("d15"), "dynamic").when(F.col("s10"), "static"))
    cells = seen.withColumns({"predicted": F.when(static, "static").otherwise("dynamic"), "actual": actual}).where("actual is not null")
    return cells.groupBy("predicted", "actual").agg(F.count("*").alias("places"), F.sum("weight").alias("n"))


TRANSFER = f"""{PACKED.replace("pts as", "pts as materialized")}, t as (select frame_id, x_mm, y_mm, z_mm, min(label) label from lab where beam % 2 = 0 group by all), e as (select distinct frame_id, x_mm, y_mm, z_mm from lab where beam % 2 = 1),
near as (select e.*, t.label, t.x_mm bx, t.y_mm by_, t.z_mm bz, (e.x_mm - t.x_mm)**2 + (e.y_mm - t.y_mm)**2 + (e.z_mm - t.z_mm)**2 d2 from
  (select *, unnest([floor(x_mm/800) - 1, floor(x_mm/800), floor(x_mm/800) + 1]) k from e) e join (select *, floor(x_mm/800) k from t) t on e.frame_id = t.frame_id and e.k = t.k where abs(e.y_mm - t.y_mm) <= 800),
given as (select frame_id, x_mm, y_mm, z_mm, arg_min(label, (d2, bx, by_, bz)) label from near where d2 <= 250000 group by 1, 2, 3, 4)"""


def transferred(spark, sf_dir) -> DataFrame:
    """Places of odd beams with the label of the nearest place of even beams within half a metre."""
    lab = packed_labels(spark, sf_dir)
    mm = {c: F.col(f"{c}_mm").cast("double") for c in "xyz"}
    truth = lab.where("beam % 2 = 0").groupBy(*_AT).agg(F.min("label").alias("label")).withColumns(mm)
    return scoring.transferred_labels(lab.where("beam % 2 = 1").select(*_AT).distinct().withColumns(mm), truth, 500.0, ["frame_id"], _AT, _order())


@query(f"with {TRANSFER} select frame_id, x_mm, y_mm, z_mm, label from given where (label & 65535) <> 252")
def label_transfer(spark, sf_dir):
    """The static part of an unlabelled cloud, by the labels of another."""
    return scoring.without_class(transferred(spark, sf_dir), 252).select(*_AT, "label")


@query(f"with {TRANSFER} select (label & 65535)::int sem, count(*) n, count(distinct label >> 16) ids from given where (label & 65535) between 252 and 259 group by 1")
def dynamic_instances(spark, sf_dir):
    """Instances of each moving class among the transferred labels."""
    return scoring.instance_ids(transferred(spark, sf_dir)).drop("about")


# ---- scans, sets, counters ----------------------------------------------------------------------------------------


@query(
    f"with pts as ({DUCK_POINTS}), {ROT}, c as (select * from rot where frame_id % 3 = 1) "
    "select p.frame_id // 3 triple, p.frame_id, p.obj_id, p.scan_key, p.beam, round(c.r0*(wx - c.px) + c.r3*(wy - c.py) + c.r6*(wz - c.pz), 6) cx, round(c.r1*(wx - c.px) + c.r4*(wy - c.py) + c.r7*(wz - c.pz), 6) cy "
    "from (select pts.*, r0*x + r1*y + r2*z + px wx, r3*x + r4*y + r5*z + py wy, r6*x + r7*y + r8*z + pz wz from pts join rot using (frame_id)) p join c on c.frame_id // 3 = p.frame_id // 3"
)
def scan_triples(spark, sf_dir):
    """Three consecutive frames in the coordinates of the middle one; triples without a middle frame drop out."""
    ps = poses(spark)
    centre = ps.where("frame_id % 3 = 1").select(F.floor(F.col("frame_id") / 3).cast("int").alias("triple"), *(F.col(c).alias(f"c_{c}") for c in ("px", "py", "pz", "roll", "pitch", "yaw")))
    joined = points(spark, sf_dir).join(F.broadcast(ps), "frame_id").withColumn("triple", F.floor(F.col("frame_id") / 3).cast("int")).join(F.broadcast(centre), "triple")
    middle = g.invert(g.rotation(F.col("c_roll"), F.col("c_pitch"), F.col("c_yaw")), [F.col(f"c_p{c}") for c in "xyz"])
    cx, cy, _ = g.apply(*g.compose(*middle, *pose_columns()), [F.col("x"), F.col("y"), F.col("z")])
    return joined.select("triple", "frame_id", "obj_id", "scan_key", "beam", r6(cx).alias("cx"), r6(cy).alias("cy"))


@query(f"with pts as ({DUCK_POINTS}) select frame_id, x_mm, y_mm, z_mm, 0::double intensity from pts")
def merged_pairs(spark, sf_dir):
    """Ground and the rest of each scan, written as two coloured clouds and merged again."""
    folder = f"{shared_dir(spark)}/scanweave/pairs-{uuid.uuid4().hex}"
    halves = points(spark, sf_dir).select((F.col("frame_id") * 2 + (F.col("sem") != 40).cast("int")).alias("frame_id"), "x", "y", "z", F.lit(1).alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b"))
    write_coloured(halves, folder)
    return scans_of_pairs(spark, folder).select("frame_id", *(F.round(F.col(c) * 1000).cast("long").alias(f"{c}_mm") for c in "xyz"), "intensity")


def voxel_lists(spark, sf_dir) -> DataFrame:
    """(frame_id, obj_id, a, b): an object's voxels in a frame and in the one after it; a frame without the object has none."""
    own = bins(spark, sf_dir).select("frame_id", "obj_id", "voxel").distinct()
    spread = own.select("frame_id", "obj_id", "voxel", F.lit(True).alias("now")).unionByName(own.select((F.col("frame_id") - 1).alias("frame_id"), "obj_id", "voxel", F.lit(False).alias("now")))
    pick = lambda now: F.array_sort(F.collect_list(F.when(F.col("now") == now, F.col("voxel"))))
    return spread.groupBy("frame_id", "obj_id").agg(pick(True).alias("a"), pick(False).alias("b"))


_LISTS = f"""{VOX}, o as (select distinct frame_id, obj_id, voxel from vox), u as (select *, true now from o union all select frame_id - 1, obj_id, voxel, false from o),
l as (select frame_id, obj_id, coalesce(list_sort(list(voxel) filter (now)), []) a, coalesce(list_sort(list(voxel) filter (not now)), []) b from u group by 1, 2)"""


@query(f"with pts as ({DUCK_POINTS}) select frame_id, x_mm, y_mm, z_mm, sem r, (obj_id % 256)::int g, refl::int b from pts where frame_id between 2 and 4")
def six_float_frames(spark, sf_dir):
    """Frames 2 to 4 of coloured scans: all are written as files of six floats a point, and only three files are read."""
    folder = f"{shared_dir(spark)}/scanweave/six-{uuid.uuid4().hex}"
    coloured = points(spark, sf_dir).selectExpr("frame_id", "x", "y", "z", "cast(sem as double) r", "cast(obj_id % 256 as double) g", "cast(refl as double) b")
    write_frame_files(coloured, folder, "xyzrgb", order=("x", "y", "z"))
    back = frames(spark, folder, "xyzrgb").where("frame_id between 2 and 4")
    return back.select("frame_id", *(F.round(F.col(c) * 1000).cast("long").alias(f"{c}_mm") for c in "xyz"), *(F.col(c).cast("int").alias(c) for c in "rgb"))


@query(f"with {_LISTS} select frame_id, obj_id, len(a)::int n_a, len(b)::int n_b, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') both_lists from l")
def vec_concat_distinct(spark, sf_dir):
    return voxel_lists(spark, sf_dir).select("frame_id", "obj_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.array_join(F.array_sort(F.array_distinct(F.concat("a", "b"))), ",").alias("both_lists"))


@query(f"with {_LISTS} select frame_id, obj_id, array_to_string(list_sort(list_filter(a, lambda v: not list_contains(b, v))), ',') only_a, list_has_any(a, b) meet from l")
def vec_except(spark, sf_dir):
    return voxel_lists(spark, sf_dir).select("frame_id", "obj_id", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("only_a"), F.arrays_overlap("a", "b").alias("meet"))


@query(f"with {BOX} select frame_id, (select count(*) from pts p where p.frame_id = b.frame_id) points_in, sum(n_pts)::bigint in_grid, sum(n_vox)::bigint voxels, count(*) clusters, count(*) filter (not (min_z > 0 or n_pts < 10 or max_z - min_z < 0.2::double)) kept from box b group by 1")
def stage_counters(spark, sf_dir):
    per = boxes(spark, sf_dir).groupBy("frame_id").agg(F.sum("n_pts").alias("in_grid"), F.sum("n_vox").alias("voxels"), F.count("*").alias("clusters"), F.count_if(segments.drop_reason(S).isNull()).alias("kept"))
    return points(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("points_in")).join(per, "frame_id").select("frame_id", "points_in", "in_grid", "voxels", "clusters", "kept")


@query(f"with {AGG}, h as (select least(cast(floor(i_mean/15) as int), 9) bin, n from agg) select bin, count(*) voxels, sum(n)::bigint n from h group by 1")
def intensity_histogram(spark, sf_dir):
    return grid(spark, sf_dir).select(F.least(F.floor(F.col("i_mean") / 15).cast("int"), F.lit(9)).alias("bin"), "n").groupBy("bin").agg(F.count("*").alias("voxels"), F.sum("n").alias("n"))


@query(
    """with t as (select user_id, list(round(value, 3) order by event_id) v from events group by 1), n as (select *, (len(v) + 1)//4 n from t), f as (select user_id, n, unnest(v) s, generate_subscripts(v, 1) - 1 pos from n),
d as (select user_id, case when pos >= 3*n then 'track' when pos % 3 = 0 then 'pre_process' when pos % 3 = 1 then 'segment' else 'recognise' end stage, s from f where pos < 4*n - 1)
select user_id, stage, count(*) n, round(avg(s), 6) mean from d group by 1, 2"""
)
def stage_times(spark, sf_dir):
    """Each user's values as one line of text, decoded as a file of stage times, and averaged per stage."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda v: F.round(v["value"], 3).cast("string")), "\t").alias("value"))
    return decoded_times(lines, "user_id").groupBy("user_id", "stage").agg(F.count("*").alias("n"), r6(F.avg("seconds")).alias("mean"))


@query("select user_id, count(*) n, round(avg(value) filter ((event_id % 3) = 0), 6) first_mean, round(avg(value) filter ((event_id % 3) = 1), 6) second_mean, round(avg(value) filter ((event_id % 3) = 2), 6) third_mean from events group by 1")
def stage_means(spark, sf_dir):
    """A flat metric series decoded by stride three, averaged per place."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda k: r6(F.avg(F.when(F.pmod("event_id", F.lit(3)) == k, F.col("value"))))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), at(0).alias("first_mean"), at(1).alias("second_mean"), at(2).alias("third_mean"))
