"""Spatial joins: bounded nearest neighbours and radius tests, a tile of space in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.tables import written
from ..shipping import ship
from .tiles import AXES, TILE, extent_of, finite, in_order, nearest_of, places, tile_index, tile_width, with_halo


def _cell(radius: float) -> list[Column]:
    return [F.floor(F.col(c) / radius).cast("long") for c in AXES]


def near_pairs(left: DataFrame, right: DataFrame, radius: float, on: list[str]) -> DataFrame:
    """left's columns, right's as r_<name>, and the squared distance d2, for all pairs within the radius.

    Each left point looks into the 27 cells around it; the join is on the cell, never on an inequality.
    """
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    cells = left.withColumns(dict(zip(("__x", "__y", "__z"), _cell(radius))))
    for c in ("__x", "__y", "__z"):
        cells = cells.withColumn("__d", F.explode(step)).withColumn(c, F.col(c) + F.col("__d")).drop("__d")
    other = right.select(*on, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on), *(v.cast("long").alias(n) for v, n in zip(_cell(radius), ("__x", "__y", "__z"))))
    joined = cells.join(other, [*on, "__x", "__y", "__z"])
    d2 = sum(((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in AXES[1:]), (F.col("x") - F.col("r_x")) * (F.col("x") - F.col("r_x")))
    return joined.withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("__x", "__y", "__z")


def _looked_up(columns: list[str], on: list[str], order: list[str], radius: float, schema: pa.Schema):
    """Left rows of a tile with `near`, what comes first by (d2, order) among the right rows in reach of it."""

    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = in_order(right, order)
        at, d2 = nearest_of(places(left), places(right), radius) if len(left) else (np.zeros(0, int), np.zeros(0))
        none = at < 0
        row = pa.array(np.maximum(at, 0), mask=none)
        kind = schema.field("near").type
        found = [pa.array(d2, mask=none), *(right.column(f.name).combine_chunks().take(row).cast(f.type) for f in list(kind)[1:])]
        near = pa.StructArray.from_arrays(found, fields=list(kind), mask=pa.array(none))
        return pa.table([*(left.column(c) for c in columns), near], schema=schema)

    return run


def with_near(left: DataFrame, right: DataFrame, radius: float, on: list[str], order: list[Column] = (), carry: list[str] | None = None) -> DataFrame:
    """left's rows and `near`, the right row (d2, r_<column>...) that comes first by (d2, order), null where none is in reach.

    Left rows go to the tile that they lie in, right rows to those that they reach; so every left row meets all that it can
    in one task, once. Inside, a grid of cells is searched, the finest first. carry: the right columns wanted, all if None.
    """
    ship(left.sparkSession)
    named = right.select(*on, *AXES, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in on)).where(finite())
    named = named.dropna(subset=on).select("*", *(c.alias(f"__o{k}") for k, c in enumerate(order)))
    wanted = [f"r_{c}" for c in (right.columns if carry is None else carry) if c not in on]
    named = named.select(*on, *AXES, *(f"__o{k}" for k in range(len(order))), *wanted)
    named = written(named, "reached")  # read thrice: for its extent, for how full tiles are, and dealt
    width = tile_width(named, on, extent_of(named), 4 * radius)
    tiles = [*on, *TILE]
    types = {f.name: f.dataType for f in named.schema.fields}
    out = StructType([*left.schema.fields, StructField("near", StructType([StructField("d2", DoubleType()), *(StructField(c, types[c]) for c in wanted)]))])
    own = left.select("*", *(tile_index(c, width).alias(t) for c, t in zip(AXES, TILE)))
    run = _looked_up(left.columns, on, [f"__o{k}" for k in range(len(order))], radius, to_arrow_schema(out))
    return own.groupBy(*tiles).cogroup(with_halo(named, width, radius).groupBy(*tiles)).applyInArrow(run, out)


def nearest(left: DataFrame, right: DataFrame, radius: float, on: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """keys of left and `near`: the right row's columns that come first by (d2, order), for left rows with one in reach."""
    return with_near(left.select(*dict.fromkeys([*on, *keys, *AXES])), right, radius, on, order).where("near is not null").select(*keys, "near")


def with_nearest(left: DataFrame, right: DataFrame, radius: float, on: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """left's columns and `near` as in nearest(), null where nothing is in reach."""
    return with_near(left, right, radius, on, order)


def within(left: DataFrame, right: DataFrame, radius: float, on: list[str], keys: list[str]) -> DataFrame:
    """left rows with some right row in reach."""
    return with_near(left, right, radius, on, carry=[]).where("near is not null").drop("near")


def beyond(left: DataFrame, right: DataFrame, radius: float, on: list[str], keys: list[str]) -> DataFrame:
    """left rows with no right row in reach."""
    return with_near(left, right, radius, on, carry=[]).where("near is null").drop("near")


def complement(cloud: DataFrame, other: DataFrame, radius: float, on: list[str], keys: list[str]) -> DataFrame:
    """Rows of cloud that are the nearest one of no row of other."""
    chosen = nearest(other, cloud, radius, on, keys, [F.col(f"r_{c}") for c in keys if c not in on]).select(*on, *(F.col(f"near.r_{c}").alias(c) for c in keys if c not in on)).distinct()
    return cloud.join(chosen, keys, "left_anti")
