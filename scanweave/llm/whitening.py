"""Whitened embeddings by tiled covariance.

Rows are cut into blocks, and each block's centred columns into column blocks that travel packed to the task of their row
block. There every pair of column blocks is multiplied; products are summed per tile within the task, then over all tasks.
The driver assembles the tiles, as many numbers as the vectors have dimension pairs, and takes the eigenvectors. What is
broadcast are means and components; no rows leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blobs
from ._frames import table
from ..shipping import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a row block and dimensions of a column block.
ROWS, TILE = 1024, 16
#: Entries this large are as good as infinite: sums of their fixed-point values would not stay exact.
LARGEST = 2.0**30
#: Eigenvalues below this share of their sum are noise of a space with fewer dimensions.
LEAST_SHARE = 1e-12


def fixed_point(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, x-vectors as int64) of the usable rows of a list<double> column."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # without those of null rows; null entries become NaN
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    rows = np.flatnonzero(length == width)
    values = flat[start[rows, None] + np.arange(width)]
    fine = (np.abs(values) < LARGEST).all(1)  # false for NaN
    return rows[fine], np.floor(values[fine] * SCALE).astype(np.int64) + SHIFT


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def vector_width(df: DataFrame) -> int:
    """The commonest length of vectors with finite entries only, the largest of several; 0 where there are none."""
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
    first = df.where(F.col("v").isNotNull() & fine).groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return first["width"] if first else 0


def _sums(width: int):
    """Per task: (dimension, sum of x), and (-1, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            x = fixed_point(batch.column("v"), width)[1]
            total += x.sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(np.concatenate([[n], total]))], ["dim", "total"])

    return run


def _column_blocks(width: int, floor: np.ndarray):
    """(row_block, col_block, payload): x less the whole part of its mean, by rows of TILE dimensions at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = fixed_point(batch.column("v"), width)[1] - floor
            for i in range(0, len(x), ROWS):
                blocks = [x[i : i + ROWS, j : j + TILE] for j in range(0, width, TILE)]
                number = (part << 32) + count
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([_blobs.pack(b.ravel()) for b in blocks], pa.binary())], ["row_block", "col_block", "payload"])
        _blobs.release()

    return run


def _tile_products(width: int, rest: np.ndarray):
    """Column blocks, those of a row block in a row and in order, to (i, j, v) with i <= j: sums of products of centred values."""
    columns = [slice(j, min(width, j + TILE)) for j in range(0, width, TILE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = {(a, b): np.zeros((columns[a].stop - columns[a].start, columns[b].stop - columns[b].start)) for a in range(len(columns)) for b in range(a, len(columns))}
        here, blocks = None, {}

        def multiply() -> None:
            for a, b in tiles:
                if blocks:
                    tiles[a, b] += blocks[a].T @ blocks[b]

        for batch in batches:
            for number, k, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if number != here:
                    multiply()
                    here, blocks = number, {}
                own = columns[k]
                blocks[k] = _blobs.unpack(payload)[0].reshape(-1, own.stop - own.start) - rest[own]
        multiply()
        for (a, b), t in tiles.items():
            i, j = np.meshgrid(np.arange(columns[a].start, columns[a].stop), np.arange(columns[b].start, columns[b].stop), indexing="ij")
            keep = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), pa.array(t[keep])], ["i", "j", "v"])
        _blobs.release()

    return run


def _assembled(sums: DataFrame, width: int) -> np.ndarray:
    """The symmetric matrix of (i, j, v) summed over all tasks: width * (width + 1) / 2 rows go to the driver."""
    out = np.zeros((width, width))
    for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


class Whitening:
    """What fit() found: n, sums S, mean as whole part and rest, covariance, and the components with their eigenvalues."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64) if n else np.zeros(len(sums), np.int64)
        self.rest = np.array([(s % n) / n for s in sums]) if n else np.zeros(len(sums))
        self.covariance = covariance
        self.trace = float(np.trace(covariance))
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1]
        order = [k for k in order if values[k] > LEAST_SHARE * self.trace][:components]
        self.values, self.vectors = values[order], vectors[:, order]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where it does not fit into a long."""
        near = x - self.floor
        most = int(np.abs(near).max(initial=0) + 1) * max(self.n, 1)
        if most * most * max(x.shape[1], 1) < 1 << 62:
            gap = near * self.n - np.array([s % self.n for s in self.sums], np.int64)
            return (gap * gap).sum(1).tolist()
        rest = np.array([s % self.n for s in self.sums], object)
        whole = [int(((row * self.n - rest) ** 2).sum()) for row in near.astype(object)]
        return [v if v < 1 << 63 else None for v in whole]


def fit(df: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of (id, v) rows, from three passes: sums, column blocks and their products."""
    long = {r["dim"]: int(r["total"]) for r in df.mapInArrow(_sums(width), "dim int, total bigint").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n, sums = long.get(-1, 0), [long.get(k, 0) for k in range(width)]
    if not n:
        return Whitening(0, sums, np.zeros((width, width)), components)
    floor, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    blocks = df.mapInArrow(_column_blocks(width, floor), "row_block bigint, col_block int, payload binary")
    products = blocks.repartition("row_block").sortWithinPartitions("row_block", "col_block").mapInArrow(_tile_products(width, rest), "i int, j int, v double")
    return Whitening(n, sums, _assembled(products, width) / n, components)


def identity_error(df: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    k, width = len(w.values), len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))  # the last row and column hold the sums
        for batch in batches:
            y = w.whitened(fixed_point(batch.column("v"), width)[1])
            y = np.concatenate([y, np.ones((len(y), 1))], 1)
            total += y.T @ y
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    total = _assembled(df.mapInArrow(run, "i int, j int, v double"), k + 1) / w.n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    Usable rows have a vector of the commonest width without null, NaN, infinite or huge (2^30 and more) entries; others are
    left out. Components go up to `components`, fewer where the vectors span fewer dimensions: equal vectors have none, and
    so no rows; nor has an empty table. A null id stays null. Repeated rows count as often as they stand. Other columns are
    not looked at. deviation is null where it does not fit into a long.
    """
    spark = embeddings.sparkSession
    ship(spark)
    df = _vectors(embeddings, id_col, vector_col)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    width = vector_width(df)
    w = fit(df, width, components) if width else None
    if not w or not len(w.values):
        return spark.createDataFrame([], schema)
    error, k, share = identity_error(df, w), len(w.values), w.values / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, x = fixed_point(part.column("v"), width)
                repeat = lambda a: a.take(pa.array(np.repeat(np.arange(len(rows)), k)))
                each = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        repeat(part.column("id").take(pa.array(rows))), pa.array(np.tile(np.arange(1, k + 1), each), pa.int32()), pa.array(np.full(each * k, w.n), pa.int64()),
                        repeat(pa.array(w.deviation(x), pa.int64())), pa.array(w.whitened(x).ravel()), pa.array(np.tile(share, each)), pa.array(np.full(each * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return df.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
