"""Packed exchange: what many rows send to one bucket travels as one binary row.

A row of an exchange is (bucket int, payload binary). The payload holds NumPy arrays, byte planes apart,
compressed. It takes a fraction of the shuffle and of the JVM time of a row per entry; the buckets are
hashes of the entries' keys, so that no key's rows can fill a bucket beyond one entry per sender.
"""

from __future__ import annotations

import ctypes
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "bucket int, payload binary"
#: Bytes of input (as stored) for which one bucket is made.
BUCKET_BYTES = 16 << 20


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and executors are sized for all of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.copy() if len(a) else a.view(np.uint8)
        body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        out.append(struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)))
        out.append(body)
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    n, at, out = payload[0], 1, []
    for _ in range(n):
        kind, rows, size = struct.unpack_from("<2sII", payload, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        raw = zstandard.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=max(1, rows * dtype.itemsize))
        at += size
        planes = np.frombuffer(raw, dtype=np.uint8)
        out.append(planes.reshape(dtype.itemsize, rows).T.copy().view(dtype).reshape(rows) if rows else np.zeros(0, dtype))
    return out


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: for file scans, the files' sizes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, size: int | None = None, each: int = BUCKET_BYTES) -> int:
    """The number of buckets for what a pass over df sends: one for `each` bytes of `size`, or of df as stored."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, math.ceil((stored_bytes(df) if size is None else size) / each)))


def batch(bucket: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])


def split(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packed row for each bucket that has entries; within a bucket the entries keep their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1)) if n <= 4 * len(bucket) + 64 else None
    if edges is None:
        own = np.unique(bucket)
        lo = np.searchsorted(bucket[order], own, "left")
        hi = np.searchsorted(bucket[order], own, "right")
    else:
        lo, hi = edges[:-1], edges[1:]
        own = np.flatnonzero(hi > lo)
        lo, hi = lo[own], hi[own]
    moved = [a[order] for a in arrays]
    return batch([int(b) for b in own], [pack(*(a[i:j] for a in moved)) for i, j in zip(lo, hi)])
