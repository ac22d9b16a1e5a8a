"""Frame files as a data source: one file for each frame, its number in the file's name.

    spark.read.format("frames").option("kind", "xyzrgb").load(folder).where("frame_id between 3 and 7")
    points.repartition("frame_id").sortWithinPartitions("frame_id", "k").write.format("frames").option("kind", "cloud").mode("append").save(folder)

Folders are reached through pyarrow's file systems by executors and driver alike, so a folder may be a URI of any store
that these know. Reading plans partitions of whole files up to `partition_bytes`, and files that a filter on frame_id rules
out are not opened. Writing puts files into a folder of the job; when all tasks have succeeded, the driver moves each to its
place. A failed job leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import io
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship

PARTITION_BYTES = 64 << 20
#: Rows of a file that are turned into columns at a time.
ROWS = 1 << 16
#: Bytes of a written frame that are copied at a time.
BYTES = 8 << 20


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a local path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def blocks(stream, record: int, left: int | None = None) -> Iterator[bytes]:
    """ROWS records of a buffered stream at a time, `left` records at most; a trailing part of one is ignored."""
    while left is None or left > 0:
        content = stream.read(record * (ROWS if left is None else min(ROWS, left)))
        whole = len(content) // record
        if not whole:
            return
        left = left and left - whole
        yield content[: whole * record]


# ---- kinds of files


@dataclass(frozen=True)
class Packed:
    """Records of equal little-endian numbers without a header; a trailing part of one is ignored."""

    ending: str
    columns: tuple[str, ...]
    number: str = "<f4"

    def read(self, stream, fields: tuple[str, ...]) -> Iterator[tuple[list[str], np.ndarray]]:
        width, size = len(self.columns), np.dtype(self.number).itemsize
        for content in blocks(stream, width * size):
            yield list(self.columns), np.frombuffer(content, self.number).reshape(-1, width)

    def head(self, rows: int, fields: tuple[str, ...]) -> bytes:
        return b""

    def body(self, values: np.ndarray, fields: tuple[str, ...]) -> bytes:
        return values.astype(self.number).tobytes()


@dataclass(frozen=True)
class Cloud:
    """Point-cloud files; fields r, g and b are one packed colour in the file."""

    ending: str = "pcd"
    columns: tuple[str, ...] = ("x", "y", "z", "intensity")

    def read(self, stream, fields: tuple[str, ...]) -> Iterator[tuple[list[str], np.ndarray]]:
        from .scans import cloud_parts

        for names, values in cloud_parts(stream):
            if "rgb" in names and not {"r", "g", "b"} & set(names):
                packed = values[:, names.index("rgb")].astype(np.int64)
                names, values = [*names, "r", "g", "b"], np.column_stack([values, packed >> 16 & 255, packed >> 8 & 255, packed & 255])
            yield names, values

    def head(self, rows: int, fields: tuple[str, ...]) -> bytes:
        from .scans import cloud_head

        plain = [f for f in fields if f not in ("r", "g", "b")]
        return cloud_head(rows, tuple(plain), len(plain) < len(fields))

    def body(self, values: np.ndarray, fields: tuple[str, ...]) -> bytes:
        from .scans import cloud_body

        plain = [k for k, f in enumerate(fields) if f not in ("r", "g", "b")]
        colours = values[:, [fields.index(c) for c in "rgb"]] if len(plain) < len(fields) else None
        return cloud_body(values[:, plain], tuple(fields[k] for k in plain), colours)


KINDS = {
    "xyzi": Packed("bin", ("x", "y", "z", "intensity")),
    "xyzrgb": Packed("bin", ("x", "y", "z", "r", "g", "b")),
    "label": Packed("label", ("label",), "<u4"),
    "cloud": Cloud(),
}


# ---- reading


@dataclass
class Files(InputPartition):
    """Whole files of one task."""

    files: list[tuple[int, str]] = field(default_factory=list)
    size: int = 0


def _bounds(f: Filter) -> tuple[float, float, set | None] | None:
    """(lowest, highest, listed ones or None) of the frames that a filter lets through; None for other filters."""
    if getattr(f, "attribute", None) != ("frame_id",):
        return None
    far = float("inf")
    match f:
        case IsNotNull():  # no frame is null
            return -far, far, None
        case EqualTo(value=v):
            return (v, v, None) if v is not None else None
        case In(value=v):
            return -far, far, set(v)
        case GreaterThan(value=v):
            return v + 1, far, None
        case GreaterThanOrEqual(value=v):
            return v, far, None
        case LessThan(value=v):
            return -far, v - 1, None
        case LessThanOrEqual(value=v):
            return -far, v, None
    return None


class FrameReader(DataSourceReader):
    def __init__(self, folder: str, kind: str, schema: StructType, partition_bytes: int):
        self.folder, self.kind, self.names, self.partition_bytes = folder, kind, [f.name for f in schema.fields], partition_bytes
        self.types = [f.dataType.simpleString() for f in schema.fields]
        self.low, self.high, self.chosen = -float("inf"), float("inf"), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = _bounds(f)
            if found is None:
                yield f
                continue
            low, high, chosen = found
            self.low, self.high = max(self.low, low), min(self.high, high)
            if chosen is not None:
                self.chosen = chosen if self.chosen is None else self.chosen & chosen

    def wanted(self, frame: int) -> bool:
        return self.low <= frame <= self.high and (self.chosen is None or frame in self.chosen)

    def listed(self) -> list[tuple[int, str, int]]:
        """(frame, path, bytes) of the wanted files by frame; empty files are among them."""
        store, top = place_of(self.folder)
        named = [(re.fullmatch(rf".*?(\d+)\.{KINDS[self.kind].ending}", i.base_name), i) for i in store.get_file_info(fs.FileSelector(top)) if i.is_file]
        return sorted((int(m[1]), i.path, i.size) for m, i in named if m and self.wanted(int(m[1])))

    def partitions(self) -> list[Files]:
        out = [Files()]
        for frame, path, size in self.listed():
            if out[-1].files and out[-1].size + size > self.partition_bytes:
                out.append(Files())
            out[-1].files.append((frame, path))
            out[-1].size += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = place_of(self.folder)
        kind, columns = KINDS[self.kind], tuple(n for n in self.names if n not in ("frame_id", "k"))
        cast = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        for frame, path in partition.files:
            before = 0
            with store.open_input_stream(path) as f:
                for names, values in kind.read(io.BufferedReader(f, 1 << 20), columns):
                    for at in range(0, len(values), ROWS):
                        part = values[at : at + ROWS]
                        n = len(part)
                        own = {"frame_id": np.full(n, frame), "k": np.arange(before, before + n)}
                        before += n
                        arrays = [own[c] if c in own else part[:, names.index(c)] if c in names else None for c in self.names]
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, cast[t]) if a is None else pc.cast(pa.array(np.ascontiguousarray(a)), cast[t], safe=False) for a, t in zip(arrays, self.types)], self.names)


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, in the job's folder."""

    files: list[tuple[int, str]]


class FrameWriter(DataSourceArrowWriter):
    """Rows of a frame must come one after the other in one task; they keep their order."""

    def __init__(self, folder: str, kind: str, schema: StructType, overwrite: bool):
        self.folder, self.kind, self.overwrite = folder, kind, overwrite
        self.fields = tuple(f.name for f in schema.fields if f.name not in ("frame_id", "k"))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = place_of(self.folder)
        kind, own = KINDS[self.kind], f"{top.rstrip('/')}/{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[int, str]] = []
        frame, rows = None, 0
        held = tempfile.TemporaryFile()  # a frame's records: its head names their number, so they wait on the task's disk

        def put() -> None:
            if frame is None:
                return
            if any(f == frame for f, _ in files):
                raise ValueError(f"rows of frame {frame} do not stand together")
            if not files:
                store.create_dir(own, recursive=True)
            path = f"{own}/{frame}.{kind.ending}"
            with store.open_output_stream(path) as out:
                out.write(kind.head(rows, self.fields))
                held.seek(0)
                while part := held.read(BYTES):
                    out.write(part)
            held.seek(0)
            held.truncate()
            files.append((frame, path))

        with held:
            for batch in iterator:
                frames = batch.column(batch.schema.get_field_index("frame_id")).to_numpy(zero_copy_only=False)
                values = np.column_stack([batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in self.fields]) if self.fields else np.zeros((len(frames), 0))
                edges = np.flatnonzero(np.concatenate([[True], frames[1:] != frames[:-1], [True]])) if len(frames) else []
                for i, j in zip(edges[:-1], edges[1:]):
                    if frame is None or int(frames[i]) != frame:
                        put()
                        frame, rows = int(frames[i]), 0
                    held.write(kind.body(values[i:j], self.fields))
                    rows += int(j - i)
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = place_of(self.folder)
        top, ending = top.rstrip("/"), KINDS[self.kind].ending
        files = sorted(f for m in messages if m is not None for f in m.files)
        for (a, _), (b, _) in zip(files, files[1:]):
            if a == b:
                raise ValueError(f"frame {a} was written by two tasks: deal rows by frame_id first")
        if self.overwrite:
            kept = {f"{f}.{ending}" for f, _ in files}
            for i in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if i.is_file and re.fullmatch(rf".*?\d+\.{ending}", i.base_name) and i.base_name not in kept:
                    store.delete_file(i.path)
        store.create_dir(top, recursive=True)
        for frame, path in files:
            store.move(path, f"{top}/{frame}.{ending}")
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        store, top = place_of(self.folder)
        self._clear(store, top.rstrip("/"))

    def _clear(self, store: fs.FileSystem, top: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{top}/{self.job}")


class FrameSource(DataSource):
    """Options: path; kind, one of KINDS; fields, comma-separated, for clouds with others than x, y, z and intensity; partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "xyzi")
        if kind not in KINDS:
            raise ValueError(f"kind {kind} is none of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        fields = [f.strip() for f in self.options["fields"].split(",")] if "fields" in self.options else KINDS[self.kind].columns
        return "frame_id int, k bigint, " + ", ".join(f"{f} {'bigint' if self.kind == 'label' else 'double'}" for f in fields)

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"], self.kind, schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], self.kind, schema, overwrite)


def frames(spark: SparkSession, folder: str, kind: str = "xyzi", **options: str) -> DataFrame:
    """The frame files of a folder; filters on frame_id decide which are opened. Registers the source in the session."""
    ship(spark)
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("frames").option("kind", kind).options(**options).load(folder)


def write_frame_files(points: DataFrame, folder: str, kind: str = "xyzi", fields: tuple[str, ...] = (), order: tuple[str, ...] = ("k",), overwrite: bool = False) -> None:
    """One file for each frame of (frame_id, fields), in the given order. A frame, as one scan, is written by one task.

    Files of frames that were there are replaced; with overwrite, those of other frames go as well.
    """
    ship(points.sparkSession)
    points.sparkSession.dataSource.register(FrameSource)
    own = fields or KINDS[kind].columns
    dealt = points.select("frame_id", *dict.fromkeys((*own, *order))).repartition("frame_id").sortWithinPartitions("frame_id", *order)
    dealt.select(dealt["frame_id"].cast("int").alias("frame_id"), *own).write.format("frames").option("kind", kind).mode("overwrite" if overwrite else "append").save(folder)
