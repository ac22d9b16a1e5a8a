"""File sources and sinks: binary scans and labels, poses, point-cloud files, object records, intensity dumps."""

from __future__ import annotations

import io
import itertools
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MOVING, Settings
from ..functions.geometry import quaternion
from ..functions.labels import object_colour
from .frames import ROWS, blocks, frames, write_frame_files

# fixed values: the packed record of the object files
OBJECT_RECORD = np.dtype([("t", "<i8"), ("intensity", "u1"), ("id", "u1"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("azimuth", "<f4"), ("range", "<f4"), ("pid", "<i4")])
_POINT = "frame_id int, k long, x double, y double, z double, intensity double"


def listed(spark: SparkSession, folder: str, ending: str) -> list[tuple[int, str, int]]:
    """(frame, path, bytes) of a folder's files with a numeric stem, by frame; empty files too, which Spark's readers skip."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    named = [(re.fullmatch(rf".*?(\d+)\.{ending}", f.getPath().getName()), f) for f in found]
    return sorted((int(m[1]), f.getPath().toString(), f.getLen()) for m, f in named if m)


def check_slice(s: Settings, frames: int) -> None:
    """Raises where the settings name frames that are not there."""
    if s.start < 0 or s.end > frames:
        raise ValueError(f"frames {s.start} to {s.end} of {frames}")


def _files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(frame_id, path, content) of the files with a numeric stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("int").alias("frame_id"), "path", "content").where("frame_id is not null")


def _decoded(decode, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for frame, content in zip(pdf["frame_id"], pdf["content"]):
                table = decode(content)
                yield pd.DataFrame({"frame_id": np.full(len(table), frame, np.int32), "k": np.arange(len(table)), **{n: table[:, i] for i, n in enumerate(names)}})

    return run


def frame_slice(df: DataFrame, s: Settings) -> DataFrame:
    """Frames start, start + skip, ... below end."""
    f = F.col("frame_id")
    return df.where((f >= s.start) & (f < s.end) & (F.pmod(f - s.start, F.lit(s.skip)) == 0))


def read_scans(spark: SparkSession, folder: str, max_intensity: float = 255.0) -> DataFrame:
    """(frame_id, k, x, y, z, intensity) from packed float32 quadruples; a trailing part of one is ignored."""

    def decode(content: bytes) -> np.ndarray:
        a = np.frombuffer(content, "<f4", len(content) // 16 * 4).reshape(-1, 4).astype(float)
        a[:, 3] = np.minimum(a[:, 3] * max_intensity, max_intensity)
        return a

    return _files(spark, folder, "bin").mapInPandas(_decoded(decode, ["x", "y", "z", "intensity"]), _POINT)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, k, label) from packed uint32; labels stay whole numbers."""
    return _files(spark, folder, "label").mapInPandas(_decoded(lambda c: np.frombuffer(c, "<u4", len(c) // 4).reshape(-1, 1).astype(np.int64), ["label"]), "frame_id int, k long, label long")


def labelled_scans(spark: SparkSession, scans: str, labels: str, max_intensity: float = 255.0, s: Settings | None = None) -> DataFrame:
    """Points joined with their labels by frame and place; raises if a scan or a label file stands alone.

    A frame has as many points as its shorter file. s: only the frames that the settings name, which must be there.
    """
    here, there = ({f for f, _, _ in listed(spark, folder, ending)} for folder, ending in ((scans, "bin"), (labels, "label")))
    if here != there:
        raise ValueError(f"frame {min(here ^ there)} has a scan or a label file only")
    a, b = read_scans(spark, scans, max_intensity), read_labels(spark, labels)
    if s:
        check_slice(s, len(here))
        a, b = frame_slice(a, s), frame_slice(b, s)
    return a.join(b, ["frame_id", "k"])


def _angles(m: np.ndarray) -> dict[str, np.ndarray]:
    """roll, pitch and yaw of an array of matrices; near the pole yaw is zero."""
    sy = np.hypot(m[:, 0, 0], m[:, 1, 0])
    pole = sy < 1e-6
    roll = np.where(pole, np.arctan2(-m[:, 1, 2], m[:, 1, 1]), np.arctan2(m[:, 2, 1], m[:, 2, 2]))
    return {"roll": roll, "pitch": np.arctan2(-m[:, 2, 0], sy), "yaw": np.where(pole, 0.0, np.arctan2(m[:, 1, 0], m[:, 0, 0]))}


def read_poses(spark: SparkSession, path: str, tr: tuple[float, ...] | None = None) -> DataFrame:
    """(frame_id, r0..r8, px, py, pz, roll, pitch, yaw) from lines of twelve numbers, row-major 3x4; frames count from 0.

    tr: scanner to camera, 4x4 by rows; camera poses become poses of the scanner, tr^-1 pose tr.
    """

    def decode(content: bytes) -> np.ndarray:
        rows = [[float(v) for v in line.split()] for line in content.decode().splitlines() if line.strip()]
        m = np.tile(np.eye(4), (len(rows), 1, 1))
        m[:, :3] = np.array(rows, dtype=float).reshape(-1, 3, 4)
        if tr is not None:
            fixed = np.array(tr, dtype=float).reshape(4, 4)
            m = np.linalg.inv(fixed) @ m @ fixed
        return m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                m = decode(content)
                rot = {f"r{3 * i + j}": m[:, i, j] for i in range(3) for j in range(3)}
                yield pd.DataFrame({"frame_id": np.arange(len(m), dtype=np.int32), **rot, "px": m[:, 0, 3], "py": m[:, 1, 3], "pz": m[:, 2, 3], **_angles(m)})

    schema = "frame_id int, " + ", ".join(f"r{k} double" for k in range(9)) + ", px double, py double, pz double, roll double, pitch double, yaw double"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_cloud_poses(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, px, py, pz, roll, pitch, yaw, time) from a point-cloud file with a point per frame, in order."""
    fields = ("x", "y", "z", "roll", "pitch", "yaw", "time")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                names, values = parse_cloud(content)
                yield pd.DataFrame({"frame_id": np.arange(len(values), dtype=np.int32), **{f"p{f}" if f in "xyz" else f: values[:, names.index(f)] for f in fields}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "frame_id int, px double, py double, pz double, roll double, pitch double, yaw double, time double")


def parse_cloud(content: bytes) -> tuple[list[str], np.ndarray]:
    """(field names, values) of an ASCII or binary point-cloud file."""
    parts = list(cloud_parts(io.BytesIO(content)))
    return parts[0][0], np.concatenate([values for _, values in parts])


def cloud_parts(stream) -> Iterator[tuple[list[str], np.ndarray]]:
    """parse_cloud() of a buffered stream, some rows at a time, one part at least. Compressed ones, a field after the other, are one part."""
    head = {}
    while "DATA" not in head:
        line = stream.readline()
        if not line.endswith(b"\n"):
            raise ValueError("the head has no DATA line")
        key, *rest = line.decode("ascii", "replace").split() or [""]
        head[key] = rest
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    # a field of several numbers gives its name to the first of them
    names = [name if i == 0 else f"{name}_{i}" for name, count in zip(head["FIELDS"], counts) for i in range(count)]
    n = int(head.get("POINTS", ["0"])[0])
    yield names, np.zeros((0, len(names)))
    if head["DATA"] == ["ascii"]:
        while lines := list(itertools.islice(stream, ROWS)):
            rows = [row for row in (line.decode().split() for line in lines) if len(row) == len(names)]
            yield names, np.array(rows, dtype=float).reshape(-1, len(names))
        return
    kinds = {"F": "f", "I": "i", "U": "u"}
    types = [f"<{kinds[t]}{size}" for t, size in zip(head["TYPE"], head["SIZE"])]
    if head["DATA"] == ["binary"]:
        record, left = np.dtype([(f"f{k}", t, (count,)) for k, (t, count) in enumerate(zip(types, counts))]), n
        for content in blocks(stream, record.itemsize, n):
            table = np.frombuffer(content, record)
            left -= len(table)
            yield names, np.concatenate([table[f].astype(float) for f in record.names], 1)
        if left:
            raise ValueError(f"{n} points are named, {n - left} are there")
    elif head["DATA"] == ["binary_compressed"]:
        packed, plain = np.frombuffer(stream.read(8), "<u4", 2).tolist()
        body, columns, start = unpacked(stream.read(packed), plain), [], 0
        for t, count in zip(types, counts):  # field after field
            columns.append(np.frombuffer(body, t, n * count, offset=start).reshape(n, count).astype(float))
            start += columns[-1].size * np.dtype(t).itemsize
        yield names, np.concatenate(columns, 1)
    else:
        raise ValueError(f"unsupported data kind {head['DATA']}")


def unpacked(packed: bytes, size: int) -> bytes:
    """The bytes behind an LZF stream: runs of literals, and copies from up to 8 KB back."""
    out, at = bytearray(), 0
    while at < len(packed):
        control = packed[at]
        at += 1
        if control < 32:
            out += packed[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += packed[at]
            at += 1
        back = ((control & 31) << 8) + packed[at] + 1
        at += 1
        start = len(out) - back
        if start < 0:
            raise ValueError("the stream refers to before its start")
        for k in range(length + 2):  # a copy may overlap itself
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} should be")
    return bytes(out)


def read_clouds(spark: SparkSession, folder: str, fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """(frame_id, k, fields) of point-cloud files; a field that a file lacks is NaN."""

    def decode(content: bytes) -> np.ndarray:
        names, values = parse_cloud(content)
        return np.stack([values[:, names.index(f)] if f in names else np.full(len(values), np.nan) for f in fields], 1)

    return _files(spark, folder, "pcd").mapInPandas(_decoded(decode, list(fields)), "frame_id int, k long, " + ", ".join(f"{f} double" for f in fields))


def cloud_bytes(values: np.ndarray, fields: tuple[str, ...] = ("x", "y", "z", "intensity"), colours: np.ndarray | None = None) -> bytes:
    """A binary point-cloud file of float32 fields, and of packed colours (n, 3) where given."""
    return cloud_head(len(values), fields, colours is not None) + cloud_body(values, fields, colours)


def _kinds(fields: tuple[str, ...], coloured: bool) -> dict[str, str]:
    return {f: "F" for f in fields} | ({"rgb": "U"} if coloured else {})


def cloud_head(n: int, fields: tuple[str, ...], coloured: bool) -> bytes:
    kinds = _kinds(fields, coloured)
    head = ["VERSION .7", f"FIELDS {' '.join(kinds)}", "SIZE" + " 4" * len(kinds), f"TYPE {' '.join(kinds.values())}", "COUNT" + " 1" * len(kinds), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary", ""]
    return "\n".join(head).encode()


def cloud_body(values: np.ndarray, fields: tuple[str, ...], colours: np.ndarray | None = None) -> bytes:
    """The records behind the head; those of parts of a file follow each other."""
    record = np.zeros(len(values), [(f, "<f4" if k == "F" else "<u4") for f, k in _kinds(fields, colours is not None).items()])
    for i, f in enumerate(fields):
        record[f] = values[:, i]
    if colours is not None:
        c = colours.astype(np.uint32)
        record["rgb"] = c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
    return record.tobytes()


def _write_each(points: DataFrame, folder: str, kind: str, fields: tuple[str, ...], order: tuple[str, ...]) -> int:
    """One file per frame through the frame source, so that a failed job leaves none; the number of files."""
    files = points.select("frame_id").distinct().count()  # a row per frame
    if files:
        write_frame_files(points, folder, kind, fields, order)
    else:
        warnings.warn(f"no points, so no files in {folder}", stacklevel=3)
    return files


def write_clouds(points: DataFrame, folder: str, fields: tuple[str, ...] = ("x", "y", "z", "intensity"), save: bool = True) -> int:
    """A point-cloud file per frame, points by k where there is one; nothing unless `save`. Frames without points have none."""
    return _write_each(points, folder, "cloud", fields, ("k",) if "k" in points.columns else fields) if save else 0


def write_coloured(points: DataFrame, folder: str) -> int:
    """A coloured point-cloud file per frame from (frame_id, x, y, z, r, g, b)."""
    columns = ("x", "y", "z", "r", "g", "b")
    return _write_each(points, folder, "cloud", columns, columns)


def write_one_colour(scans: DataFrame, folder: str, r: int, g: int, b: int) -> int:
    """Scans as clouds of a single colour."""
    return write_coloured(scans.withColumns({"r": F.lit(r), "g": F.lit(g), "b": F.lit(b)}), folder)


def write_scans(points: DataFrame, folder: str) -> int:
    """Packed float32 quadruples, the form that read_scans() reads, in order of k."""
    return _write_each(points, folder, "xyzi", (), ("k",))


def read_coloured_scans(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, k, x, y, z, r, g, b) from packed float32 sextuples; filters on frame_id decide which files are opened."""
    return frames(spark, folder, "xyzrgb")


def merged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, x, y, z, intensity) of cloud files taken in pairs, by number: ground and the rest of a scan become one frame.

    Frames count from 0, intensities are 0, and a last file without a partner is a frame of its own.
    """
    order = {f: k // 2 for k, (f, _, _) in enumerate(listed(spark, folder, "pcd"))}
    pair = spark.createDataFrame(list(order.items()), "frame_id int, pair int")  # a row per file
    read = frames(spark, folder, "cloud", fields="x,y,z")
    return read.join(pair, "frame_id").select(F.col("pair").alias("frame_id"), "x", "y", "z", F.lit(0.0).alias("intensity"))


def read_text_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, k, x, y, z, intensity): the lines of exactly four numbers, up to the first blank line."""

    def decode(content: bytes) -> np.ndarray:
        lines = content.decode("ascii", "replace").split("\n")
        blank = next((i for i, line in enumerate(lines) if not line.strip()), len(lines))
        rows = [line.strip().split(" ") for line in lines[:blank]]
        return np.array([[float(v) for v in r] for r in rows if len(r) == 4 and _numbers(r)], dtype=float).reshape(-1, 4)

    return _files(spark, folder, "pcd").mapInPandas(_decoded(decode, ["x", "y", "z", "intensity"]), _POINT)


def _numbers(words: list[str]) -> bool:
    try:
        return [float(w) for w in words] is not None
    except ValueError:
        return False  # a header line of four words


def write_poses(poses: DataFrame, path: str, s: Settings | None = None) -> None:
    """Twelve numbers a line in frame order, from r0..r8 and px, py, pz: one file, a line per frame."""
    numbers = [F.col(c).cast("string") for i in range(3) for c in (f"r{3 * i}", f"r{3 * i + 1}", f"r{3 * i + 2}", f"p{'xyz'[i]}")]
    own = poses if s is None else poses.where((F.col("frame_id") >= s.start) & (F.col("frame_id") <= s.end))
    own.select("frame_id", F.concat_ws(" ", *numbers).alias("value")).coalesce(1).sortWithinPartitions("frame_id").select("value").write.mode("overwrite").text(path)


def write_quaternions(poses: DataFrame, path: str, s: Settings) -> None:
    """Frame from the start, frame, place and quaternion (x, y, z, w) of the frames from start to end, both included."""
    q = quaternion([F.col(f"r{k}") for k in range(9)])
    own = poses.where((F.col("frame_id") >= s.start) & (F.col("frame_id") <= s.end))
    rows = own.select((F.col("frame_id") - s.start).alias("ordinal"), "frame_id", "px", "py", "pz", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))))
    rows.coalesce(1).sortWithinPartitions("ordinal").write.mode("overwrite").csv(path)


def write_segments(points: DataFrame, clusters: DataFrame, folder: str, moving: bool | None = None) -> int:
    """Segmented points, coloured by state and type, a file per frame; a car at rest has the colour of its track.

    points: frame_id, cluster_id, x, y, z. clusters: frame_id, cluster_id, type, state, track_id; clusters without a type
    were left out and are not written. moving: only the points of moving objects, or only those of the others.
    """
    shade = lambda salt: (F.pmod(F.xxhash64(F.coalesce("track_id", "cluster_id"), F.lit(salt)), F.lit(180)) + 20).cast("int")
    fixed = object_colour(F.col("type"), F.col("state"))
    own = clusters.where("type is not null").withColumn("c", F.coalesce(fixed, F.struct(shade(1).alias("r"), shade(2).alias("g"), shade(3).alias("b"))))
    if moving is not None:
        moves = F.coalesce(F.col("state") == MOVING, F.lit(False))
        own = own.where(moves if moving else ~moves)
    return write_coloured(points.join(own.select("frame_id", "cluster_id", "c.r", "c.g", "c.b"), ["frame_id", "cluster_id"]), folder)


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Object records: t, intensity, id, x, y, z, azimuth, range, pid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                a = np.frombuffer(content, OBJECT_RECORD, len(content) // OBJECT_RECORD.itemsize)
                yield pd.DataFrame({"path": path, **{n: a[n].astype(float if a[n].dtype.kind == "f" else np.int64) for n in OBJECT_RECORD.names}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    kinds = ", ".join(f"`{n}` {'double' if OBJECT_RECORD[n].kind == 'f' else 'long'}" for n in OBJECT_RECORD.names)
    return files.mapInPandas(run, f"path string, {kinds}")


def write_frames(points: DataFrame, path: str) -> None:
    """One folder per frame, for later partition pruning."""
    points.write.partitionBy("frame_id").mode("overwrite").parquet(path)


def write_intensity(voxels: DataFrame, path: str) -> None:
    """Voxel intensities, tab-separated: mean, and variance over a hundred."""
    voxels.select("frame_id", "voxel", "i_mean", (F.col("i_var") / 100).alias("i_spread")).write.mode("overwrite").option("sep", "\t").csv(path)


def read_intensity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("frame_id int, voxel long, i_mean double, i_spread double").csv(path)


def decoded_times(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, stage, frame, seconds) from lines (keys, value) of tab-separated numbers.

    A line of n frames has three numbers for each frame in turn (pre-process, segment, recognise), then n - 1 of tracking,
    one for each frame but the last. Numbers beyond 4 n - 1 for the largest such n are left out, blank ones are skipped.
    """
    numbers = F.filter(F.split("value", r"\s+"), lambda v: v != "")
    out = lines.select(*keys, numbers.alias("v")).withColumn("n", F.floor((F.size("v") + 1) / 4).cast("int"))
    flat = out.select(*keys, "n", F.posexplode("v").alias("pos", "text")).where(F.col("pos") < 4 * F.col("n") - 1)
    tracked = F.col("pos") - 3 * F.col("n")
    names = F.array(*map(F.lit, ("pre_process", "segment", "recognise")))
    stage = F.when(tracked >= 0, "track").otherwise(F.element_at(names, F.pmod("pos", F.lit(3)) + 1))
    frame = F.when(tracked >= 0, tracked).otherwise(F.floor(F.col("pos") / 3).cast("int"))
    return flat.select(*keys, stage.alias("stage"), frame.alias("frame"), F.col("text").cast("double").alias("seconds"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """decoded_times() of text files, with the file's path."""
    return decoded_times(spark.read.text(path).withColumn("path", F.input_file_name()), "path")
