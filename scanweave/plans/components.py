"""Connected components: tasks reduce their edges to forests, then large-star and small-star steps join these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import written

#: Edges that a task holds before it reduces them, and nodes beyond which it hands its forest on.
HELD_EDGES, HELD_NODES = 1 << 20, 1 << 21
#: A forest of at most so many edges is joined by one task, 16 bytes an edge; larger ones by steps over all executors.
ONE_TASK_EDGES = 1 << 19


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes ascending, least node that each reaches): roots hook onto smaller ones, then all paths are halved."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return nodes, nodes[root]


def _forest(whole: bool):
    """Edges (a, b) to (node, least node reached within the task); with `whole`, of all nodes, else of those that are not least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros((2, 0), np.int64)], 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            return least_reached(*np.concatenate(held, axis=1))

        def out(nodes: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            keep = slice(None) if whole else nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size > HELD_EDGES:
                nodes, least = reduced()
                held, size = [np.stack([nodes, least])], 0
                if len(nodes) > HELD_NODES and not whole:
                    yield out(nodes, least)
                    held = [np.zeros((2, 0), np.int64)]
        yield out(*reduced())

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): for each node of an edge (a, b), the least node that it reaches. Nodes are longs, none null.

    Loops and repeated edges do no harm. Edges are dealt to tasks by ranges of their nodes, so that neighbours in
    number meet; each task passes on a spanning forest of its edges. Forests of more than `one_task_edges` edges are
    joined by rounds of two star steps, each written to the shared folder; log-many suffice, and a forest that has not
    settled after `rounds` of them raises.
    """
    ship(edges.sparkSession)
    given = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    star = written(given.where("a <> b").repartitionByRange("a", "b").mapInArrow(_forest(False), "a long, b long"), "forest")
    loops = given.where("a = b").select(F.col("a").alias("node")).distinct()
    found = None
    if star.limit(one_task_edges + 1).count() <= one_task_edges:
        found = written(star.coalesce(1).mapInArrow(_forest(True), "a long, b long").toDF("node", "component"), "components")
    for _ in range(rounds):
        if found is not None:
            alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
            return found.unionByName(alone)
        star = written(_small_star(_large_star(star)), "star")
        # settled when no node that stands under another has nodes under itself
        if not star.join(star.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            found = star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
