"""Frame-to-frame overlap, object states, and the fold over a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CAR_TYPE, MOVING, STATIC, UNKNOWN, Settings
from ..functions.geometry import apply, computed, invert, rotation
from ..plans.components import connected_components
from ..plans.tables import ranked, written
from .voxels import FRAME, LEAST_KEY, binned


def frame_pairs(frames: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """(frame_id, next_frame): each frame with the one after it, whatever the stride. A row per frame, no points.

    sequences: (frame_id, sequence), one row per frame; the last frame of a sequence has no next one.
    """
    own, one = frames.select("frame_id").distinct(), F.lit(0)
    if sequences is not None:
        own, one = own.join(sequences, "frame_id"), F.col("sequence")
    return own.withColumn("next_frame", F.lead("frame_id").over(Window.partitionBy(one).orderBy("frame_id"))).where("next_frame is not null").select("frame_id", "next_frame")


def moved_points(points: DataFrame, pairs: DataFrame, poses: DataFrame | None = None) -> DataFrame:
    """points in the next frame's coordinates, with that frame's number in next_frame. Without poses nothing moves."""
    return turned_points(points.join(F.broadcast(pairs), "frame_id"), poses)  # a row per frame


def turned_points(paired: DataFrame, poses: DataFrame | None = None) -> DataFrame:
    """Points of frame_id in the coordinates of next_frame."""
    if poses is None:
        return paired
    # twelve numbers for each frame, so that points cost multiplications only
    place = poses.select("frame_id", *(c.alias(f"r{k}") for k, c in enumerate(rotation(F.col("roll"), F.col("pitch"), F.col("yaw")))), "px", "py", "pz")
    names = [c for c in place.columns if c != "frame_id"]
    here = place.select("frame_id", *(F.col(c).alias(f"__a_{c}") for c in names))
    there = place.select(F.col("frame_id").alias("next_frame"), *(F.col(c).alias(f"__b_{c}") for c in names))
    both = paired.join(F.broadcast(here), "frame_id").join(F.broadcast(there), "next_frame")
    pose = lambda p: ([F.col(f"__{p}_r{k}") for k in range(9)], [F.col(f"__{p}_p{c}") for c in "xyz"])
    world = computed(both, dict(zip("xyz", apply(*pose("a"), [F.col("x"), F.col("y"), F.col("z")]))))
    r, t = pose("b")
    back, zero = invert(r, t)[0], [F.lit(0.0)] * 3
    turned = computed(world, dict(zip("xyz", apply(back, zero, [F.col(c) - v for c, v in zip("xyz", t)]))))
    return turned.drop(*(f"__{p}_{c}" for p in "ab" for c in names))


def overlap_matches(clustered: DataFrame, components: DataFrame, s: Settings, poses: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(frame_id, cluster_id, next_frame, match_id, voxels): voxels of each next-frame cluster that a cluster's moved points hit.

    pairs: which frames are compared, each with the one after it unless given.
    """
    moved = moved_points(clustered.select("frame_id", "cluster_id", "x", "y", "z"), frame_pairs(components) if pairs is None else pairs, poses)
    hit = binned(moved, s).select("frame_id", "cluster_id", "next_frame", "voxel").distinct()
    labels = components.select(F.col("frame_id").alias("next_frame"), "voxel", F.col("cluster_id").alias("match_id"))
    return hit.join(labels, ["next_frame", "voxel"]).groupBy("frame_id", "cluster_id", "next_frame", "match_id").agg(F.count("*").alias("voxels"))


def base_frame(clusters: DataFrame) -> DataFrame:
    """(frame_id, clusters): one row, the frame with the fewest clusters, the last of several; no row where there are none."""
    counts = clusters.select("frame_id", "cluster_id").distinct().groupBy("frame_id").agg(F.count("*").alias("clusters"))
    one = counts.agg(F.min(F.struct("clusters", (-F.col("frame_id")).alias("last"))).alias("m")).where("m is not null")
    return one.select((-F.col("m.last")).alias("frame_id"), F.col("m.clusters").alias("clusters"))


def base_fusion(clustered: DataFrame, components: DataFrame, s: Settings, poses: DataFrame | None = None) -> DataFrame:
    """(frame_id, cluster_id, fused_id) of the base frame's clusters: what one cluster of another frame covers is one object.

    A cluster of another frame, moved into the base frame, that meets several clusters there joins those of which it hits
    the share s.occupancy or more; joined clusters are components of the graph of such joins, named by the least.
    """
    base = written(base_frame(components).select("frame_id"), "base")
    pairs = components.select("frame_id").distinct().join(F.broadcast(base.select(F.col("frame_id").alias("next_frame"))), F.col("frame_id") != F.col("next_frame"))  # one row
    own = components.join(F.broadcast(base), "frame_id")
    sizes = own.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n_vox"))
    matches = overlap_ratios(overlap_matches(clustered, components, s, poses, pairs), sizes)
    groups = matches.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("m"), F.array_compact(F.collect_list(F.when(F.col("ratio") >= s.occupancy, F.col("match_id")))).alias("ids")).where((F.col("m") > 1) & (F.size("ids") > 0))
    found = connected_components(groups.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"))).toDF("node", "fused")
    named = sizes.join(found, sizes["cluster_id"] == found["node"], "left")
    return named.select("frame_id", "cluster_id", F.coalesce("fused", "cluster_id").alias("fused_id"))


def overlap_ratios(matches: DataFrame, boxes: DataFrame) -> DataFrame:
    """matches with the share of the matched cluster's voxels that were hit."""
    sizes = boxes.select(F.col("frame_id").alias("next_frame"), F.col("cluster_id").alias("match_id"), F.col("n_vox").alias("match_vox"))
    return matches.join(sizes, ["next_frame", "match_id"]).withColumn("ratio", F.col("voxels") / F.col("match_vox"))


def match_fanout(boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """(frame_id, cluster_id, m): matched clusters of each cluster of a frame that has a next one."""
    own = boxes.select("frame_id", "cluster_id").join(F.broadcast(frame_pairs(boxes)), "frame_id")
    counts = matches.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("found"))
    return own.join(counts, ["frame_id", "cluster_id"], "left").select("frame_id", "cluster_id", F.coalesce("found", F.lit(0)).cast("long").alias("m"))


def state_rule(m: Column, ratio: Column, match_type: Column, s: Settings) -> Column:
    """A car's state from its matches: none, one, or several."""
    one = F.when(ratio < s.occupancy, F.when(match_type == CAR_TYPE, MOVING).otherwise(STATIC)).otherwise(F.when(match_type == CAR_TYPE, STATIC).otherwise(UNKNOWN))
    return F.when(m == 0, MOVING).when(m == 1, one).otherwise(STATIC)


def pair_states(typed: DataFrame, matches: DataFrame, s: Settings) -> DataFrame:
    """(frame_id, cluster_id, m, state) of all cars of frames that have a next one, each pair of frames by itself."""
    ratios = overlap_ratios(matches, typed)
    types = typed.select(F.col("frame_id").alias("next_frame"), F.col("cluster_id").alias("match_id"), F.col("type").alias("match_type"))
    # with a single match, its ratio and type are the maxima
    one = ratios.join(types, ["next_frame", "match_id"]).groupBy("frame_id", "cluster_id").agg(F.count("*").alias("found"), F.max("ratio").alias("ratio"), F.max("match_type").alias("match_type"))
    cars = typed.where(F.col("type") == CAR_TYPE).select("frame_id", "cluster_id").join(F.broadcast(frame_pairs(typed)), "frame_id")
    m = F.coalesce("found", F.lit(0))
    return cars.join(one, ["frame_id", "cluster_id"], "left").select("frame_id", "cluster_id", m.cast("long").alias("m"), state_rule(m, F.col("ratio"), F.col("match_type"), s).alias("state"))


#: Frames that the points of a car are moved ahead at first; where the car may stand for longer, twice as many follow.
AHEAD = 8


def placed_frames(frames: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """(sequence, frame_id, place, last): frames numbered in their sequence, a row per frame; last is the last place."""
    own = frames.select("frame_id").distinct()
    own = own.withColumn("sequence", F.lit("")) if sequences is None else own.join(sequences.select("frame_id", F.col("sequence").cast("string").alias("sequence")), "frame_id")
    w = Window.partitionBy("sequence")
    return own.select("sequence", "frame_id", F.row_number().over(w.orderBy("frame_id")).alias("place"), F.count("*").over(w).cast("int").alias("last"))


def _node(frame: str, cluster: str) -> Column:
    return F.col(frame).cast("long") * FRAME + F.col(cluster) - LEAST_KEY


def car_hits(points: DataFrame, todo: DataFrame, frames: DataFrame, components: DataFrame, s: Settings, poses: DataFrame | None = None) -> DataFrame:
    """(node, lag, voxel, match_id, match_node): voxels of clusters of later frames that the points of cars reach.

    todo: (node, sequence, place, done, until): cars by frame and cluster, and the lags done + 1 to until they are wanted for.
    """
    lags = todo.withColumn("lag", F.explode(F.sequence(F.col("done") + 1, "until"))).withColumn("next_place", F.col("place") + F.col("lag"))
    there = frames.select("sequence", F.col("place").alias("next_place"), F.col("frame_id").alias("next_frame"))
    wanted = lags.join(there, ["sequence", "next_place"]).select("node", "lag", "next_frame")
    moved = turned_points(points.join(wanted, "node"), poses)
    hit = binned(moved, s).select("node", "lag", "next_frame", "voxel").distinct()
    labels = components.select(F.col("frame_id").alias("next_frame"), "voxel", F.col("cluster_id").alias("match_id"))
    return hit.join(labels, ["next_frame", "voxel"]).select("node", "lag", "voxel", "match_id", _node("next_frame", "match_id").alias("match_node"))


def fold(clusters: dict[int, dict[int, tuple[int, int]]], hits: dict[tuple[int, int], dict[int, dict[int, int]]], occupancy: float, last: int) -> list[tuple]:
    """Tracks one group of clusters: rows (place, cluster, made, type, state, track), in order of places and clusters.

    clusters: place of a frame -> cluster -> (type, voxels). hits: (place, car) -> later place -> voxel that the car's points
    reach -> cluster that it belongs to. last: the sequence's last place. Cars are taken by ascending cluster, made ones last;
    what a car does to the next frame, later cars and later frames see. A car that stands where a car of the next frame is
    hands it its points, and those it was given. Made clusters have no number yet: `made` is the path of the car that made
    one, `track` that of the first car of a track. The path of a car is (place, 0, cluster), that of a made one (place, 1,
    its maker's path), so paths order as their cars are taken. A made cluster that is no car has a row with a null type.
    """
    out: list[tuple] = []
    # a cluster is (0, number), or (1, how many were made before it)
    now = {(0, c): v for c, v in clusters[min(clusters)].items()} if clusters else {}
    made: dict[tuple, tuple] = {}  # path of the maker
    parts: dict[tuple, list[int]] = {}  # clusters that a made car consists of
    given: dict[tuple, list[tuple[int, int]]] = {}  # cars of earlier frames whose points a car has
    tracks: dict[tuple, tuple] = {}
    for place in range(min(clusters), max(clusters) + 1) if clusters else ():
        following = {(0, c): v for c, v in clusters.get(place + 1, {}).items()}
        label = {v: (0, m) for ahead in hits.values() for v, m in ahead.get(place + 1, {}).items()}
        held: dict[tuple, set[int]] = {}
        for v, n in label.items():
            held.setdefault(n, set()).add(v)
        next_made, next_parts, next_given, next_tracks = {}, {}, {}, {}
        for c in sorted(n for n, (kind, _) in now.items() if kind == CAR_TYPE):
            path = (place, 0, c[1]) if c[0] == 0 else (place, 1, *made[c])
            track, kind, state = tracks.get(c, path), CAR_TYPE, UNKNOWN
            carried = [*((place, m) for m in parts.get(c, [c[1]])), *given.get(c, ())]
            matched: dict[tuple, set[int]] = {}
            for car in carried if place < last else ():
                for v in hits.get(car, {}).get(place + 1, ()):
                    if label[v] in following:
                        matched.setdefault(label[v], set()).add(v)
            fresh = (1, len(next_made))
            if place == last:
                pass
            elif not matched:
                state = MOVING
            elif len(matched) == 1:
                (n, both), = matched.items()
                other, size = following[n]
                enough = len(both) >= occupancy * size
                if other == CAR_TYPE:
                    state = STATIC if enough else MOVING
                    if enough:
                        next_tracks[n] = track
                        next_given.setdefault(n, []).extend(carried)
                elif not enough:
                    # what was hit leaves the other cluster as one of its own
                    state, kind = STATIC, other
                    following[n], following[fresh] = (other, size - len(both)), (other, len(both))
                    held[n] -= both
                    held[fresh], next_made[fresh] = both, path
                    label.update(dict.fromkeys(both, fresh))
                    out.append((place + 1, None, path, None, None, None))
            else:
                state = STATIC
                joined = [n for n, both in matched.items() if following[n][0] == CAR_TYPE and len(both) >= occupancy * following[n][1]]
                if joined:
                    following[fresh] = (CAR_TYPE, sum(following.pop(n)[1] for n in joined))
                    held[fresh] = set().union(*(held.pop(n) for n in joined))
                    next_made[fresh], next_parts[fresh], next_tracks[fresh] = path, [m for n in joined for m in next_parts.get(n, [n[1]])], track
                    for n in joined:
                        next_given.pop(n, None)
                    label.update(dict.fromkeys(held[fresh], fresh))
            out.append((place, *((c[1], None) if c[0] == 0 else (None, made[c])), kind, state, track))
        now, made, parts, given, tracks = following, next_made, next_parts, next_given, next_tracks
    return out


_FOLDED = "sequence string, place int, cluster_id bigint, made array<bigint>, type int, state int, track array<bigint>"


def _fold_groups(occupancy: float):
    """Rows of groups, one after the other, to what fold() makes of each."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _FOLDED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, clusters, hits = None, [], {}, {}
        last, sequence = 0, ""
        for b in batches:
            for bond, kind, name, place, cluster, x, y, z in zip(*(c.to_pylist() for c in b.columns)):
                if bond != here:
                    rows.extend((sequence, *r) for r in fold(clusters, hits, occupancy, last))
                    here, sequence, clusters, hits = bond, name, {}, {}
                if kind:
                    hits.setdefault((place, cluster), {}).setdefault(x, {})[y] = z
                else:
                    clusters.setdefault(place, {})[cluster], last = (x, y), z
            if len(rows) > 4096:
                yield batch(rows)
                rows = []
        yield batch([*rows, *((sequence, *r) for r in fold(clusters, hits, occupancy, last))])

    return run


def tracking_fold(clustered: DataFrame, components: DataFrame, typed: DataFrame, s: Settings, poses: DataFrame | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """(frame_id, cluster_id, type, state, track_id) of the cars of each sequence; track ids start anew in each.

    What the points of cars reach in later frames is found in parallel, up to AHEAD frames on, and further for cars that may
    stand so long: those whose group has a car in every frame between. Clusters that such hits link form groups; only within
    a group does order matter, so a task folds the cluster graph of one group, without points. Made clusters and tracks are
    numbered over all groups afterwards, in the order in which a single pass over the sequence would make them.
    sequences: (frame_id, sequence) where there are several, with frame ids of their own; else all frames are one.
    """
    typed = written(typed.select("frame_id", "cluster_id", "type"), "types")
    frames = written(placed_frames(typed, sequences), "places")
    live = components.join(typed.select("frame_id", "cluster_id"), ["frame_id", "cluster_id"], "left_semi")
    sizes = live.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n_vox"))
    nodes = written(sizes.join(typed, ["frame_id", "cluster_id"]).join(frames, "frame_id").withColumn("node", _node("frame_id", "cluster_id")), "nodes")
    cars = nodes.where(F.col("type") == CAR_TYPE)
    points = clustered.select(_node("frame_id", "cluster_id").alias("node"), "frame_id", "x", "y", "z").join(cars.select("node"), "node", "left_semi")
    todo = cars.select("node", "sequence", "place", F.lit(0).alias("done"), F.lit(AHEAD).alias("until"))
    hits = None
    while True:
        found = written(car_hits(points, todo, frames, live, s, poses), "hits")
        hits = found if hits is None else hits.unionByName(found)
        linked = connected_components(hits.select(F.col("node").alias("a"), F.col("match_node").alias("b")).distinct()).toDF("node", "bond")
        bonds = written(nodes.join(linked, "node", "left").withColumn("bond", F.coalesce("bond", "node")), "bonds")
        # further on for those that are not at the end yet, and whose group has cars at all places until there
        reach = written(todo.select("node", F.col("until").alias("done")), "reach") if hits is found else written(reach.join(todo.select("node", "until"), "node", "left").select("node", F.coalesce("until", "done").alias("done")), "reach")
        open_ = reach.join(bonds.where(F.col("type") == CAR_TYPE), "node").where(F.col("place") + F.col("done") < F.col("last"))
        if not open_.limit(1).count():
            break
        between = bonds.where(F.col("type") == CAR_TYPE).select("sequence", "bond", F.col("place").alias("there")).distinct()
        kept = open_.join(between, ["sequence", "bond"]).where((F.col("there") > F.col("place")) & (F.col("there") <= F.col("place") + F.col("done")))
        stand = kept.groupBy("node", "sequence", "place", "done").agg(F.count("*").alias("k")).where(F.col("k") == F.col("done"))
        todo = written(stand.select("node", "sequence", "place", "done", (2 * F.col("done")).alias("until")), "standing")
        if not todo.limit(1).count():
            break
    mine = bonds.join(bonds.where(F.col("type") == CAR_TYPE).select("bond").distinct(), "bond", "left_semi")
    # one stream of rows: a group's clusters, then what its cars reach
    graph = mine.select("bond", F.lit(0).alias("kind"), "sequence", "place", "cluster_id", F.col("type").cast("long").alias("a"), F.col("n_vox").alias("b"), F.col("last").cast("long").alias("c"))
    reached = hits.join(bonds.select("node", "bond", "sequence", "place", "cluster_id"), "node").select("bond", F.lit(1).alias("kind"), "sequence", "place", "cluster_id", (F.col("place") + F.col("lag")).cast("long").alias("a"), F.col("voxel").alias("b"), F.col("match_id").alias("c"))
    ordered = graph.unionByName(reached).repartition("bond").sortWithinPartitions("bond", "kind")
    folded = written(ordered.mapInArrow(_fold_groups(s.occupancy), _FOLDED), "folded")
    made = ranked(folded.where("made is not null").select("sequence", "made").distinct(), ["sequence"], ["made"], "number")
    tracks = ranked(folded.where("track is not null").select("sequence", "track").distinct(), ["sequence"], ["track"], "track_id")
    fresh = nodes.groupBy("sequence").agg((F.max("cluster_id") + 1).alias("base"))
    named = folded.where("type is not null").join(made, ["sequence", "made"], "left").join(fresh, "sequence").join(tracks, ["sequence", "track"]).join(frames.select("sequence", "place", "frame_id"), ["sequence", "place"])
    return named.select("frame_id", F.coalesce("cluster_id", F.col("base") + F.col("number")).alias("cluster_id"), "type", "state", "track_id")
