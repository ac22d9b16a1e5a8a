"""Ground: concentric zones, seeds, plane fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import planar_range
from ..plans.tables import written
from .features import moments

# fixed values: the zone model
MIN_RANGE, MAX_RANGE = 2.7, 80.0
BORDERS = (2.7, 12.3625, 22.025, 41.35, 80.0)
RINGS = (2, 4, 4, 4)
SECTORS = (16, 32, 54, 32)
ELEVATION = (-1.2, -0.9984, -0.851, -0.605)
FLATNESS = (0.0, 0.000125, 0.000185, 0.000185)
UPRIGHT, SEED_POINTS, SEED_HEIGHT, PLANE_DISTANCE, ROUNDS, LEAST_POINTS = 0.707, 20, 0.3, 0.1, 3, 10
PATCH = ["frame_id", "zone", "ring", "sector"]


def _by_zone(values: list[Column]) -> Column:
    zone = F.col("zone")
    return F.when(zone == 0, values[0]).when(zone == 1, values[1]).when(zone == 2, values[2]).otherwise(values[3])


def with_zones(points: DataFrame, sensor_height: float) -> DataFrame:
    """Points above the reflections below ground, with zone, ring and sector; points outside all zones have none."""
    x, y = F.col("x"), F.col("y")
    turned = F.atan2(y, x)
    out = points.where(F.col("z") >= -1.8 * sensor_height).withColumns({"zr": planar_range(x, y), "zt": F.when(turned >= 0, turned).otherwise(turned + 2 * math.pi)})
    r = F.col("zr")
    out = out.withColumn("zone", F.when((r > MIN_RANGE) & (r <= MAX_RANGE), F.when(r < BORDERS[1], 0).when(r < BORDERS[2], 1).when(r < BORDERS[3], 2).otherwise(3)))
    ring = _by_zone([F.least(((r - BORDERS[k]) / ((BORDERS[k + 1] - BORDERS[k]) / RINGS[k])).cast("int"), F.lit(RINGS[k] - 1)) for k in range(4)])
    sector = _by_zone([F.least((F.col("zt") / (2 * math.pi / SECTORS[k])).cast("int"), F.lit(SECTORS[k] - 1)) for k in range(4)])
    return out.withColumns({"ring": F.when(F.col("zone").isNotNull(), ring), "sector": F.when(F.col("zone").isNotNull(), sector)}).drop("zr", "zt")


def lowest_seeds(zoned: DataFrame, sensor_height: float, count: int = SEED_POINTS) -> DataFrame:
    """The `count` lowest points of each patch; the innermost zone skips what lies far below the sensor."""
    usable = zoned.where(F.col("zone").isNotNull() & ~((F.col("zone") == 0) & (F.col("z") < -1.1 * sensor_height)))
    rank = F.row_number().over(Window.partitionBy(*PATCH).orderBy("z", "x", "y"))
    return usable.withColumn("rank", rank).where(F.col("rank") <= count)


def seed_heights(zoned: DataFrame, sensor_height: float) -> DataFrame:
    return lowest_seeds(zoned, sensor_height).groupBy(*PATCH).agg(F.avg("z").alias("lpr"), F.count("*").alias("seeds"))


def plane(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normal with upward z, mean, variances descending) of the least-squares plane."""
    mean = points.mean(0)
    values, vectors = np.linalg.eigh((points - mean).T @ (points - mean) / len(points))
    normal = vectors[:, 0]
    return (normal if normal[2] >= 0 else -normal), mean, values[::-1]


def is_ground(xyz: np.ndarray, zone: int, ring: int, sensor_height: float) -> np.ndarray:
    """Which of a patch's points are ground: seeds, three plane fits, then the checks on the fitted plane."""
    z = np.sort(xyz[:, 2])
    usable = z[z >= -1.1 * sensor_height] if zone == 0 else z
    lpr = usable[:SEED_POINTS].mean() if len(usable) else 0.0
    inside = xyz[:, 2] < lpr + SEED_HEIGHT
    if not inside.any():
        return inside
    normal, mean, spread = plane(xyz[inside])
    for k in range(ROUNDS):
        inside = (xyz - mean) @ normal < PLANE_DISTANCE
        if k < ROUNDS - 1 and inside.any():
            normal, mean, spread = plane(xyz[inside])
    upright = abs(normal[2]) >= UPRIGHT
    # the rings nearest to the sensor, counted over all zones, have thresholds
    checked = sum(RINGS[:zone]) + ring
    if upright and checked < len(ELEVATION) and mean[2] > ELEVATION[checked]:
        upright = FLATNESS[checked] > spread[2] / max(spread.sum(), 1e-300)
    return inside & upright


_PLANE = [*(f"n{c}" for c in "xyz"), *(f"m{c}" for c in "xyz"), "flat"]


def planes(points: DataFrame) -> DataFrame:
    """The least-squares plane of each patch's points: normal with upward z, mean, and the least variance's share of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spread = b[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(spread)
            normal = vectors[:, :, 0] * np.where(vectors[:, 2:, 0] >= 0, 1, -1)
            flat = values[:, 0] / np.maximum(values.sum(1), 1e-300)
            yield pd.concat([b[PATCH], pd.DataFrame(np.column_stack([normal, b[["mean_x", "mean_y", "mean_z"]], flat]), columns=_PLANE, index=b.index)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in PATCH), *(f"{c} double" for c in _PLANE)])
    return written(moments(points, *PATCH).mapInPandas(run, schema), "planes")


def ground_split(points: DataFrame, sensor_height: float) -> DataFrame:
    """points with status: ground, in_grid for what stands on it, unassigned for thin patches and points outside zones.

    The rule of is_ground() for all patches at once: a plane fit is an aggregate of moments, merged from partial ones of each
    task, so a pass over the points for each fit, and no patch is held anywhere. What joins is a row for each patch.
    """
    zoned = with_zones(points, sensor_height)
    outside = zoned.where("zone is null").withColumn("status", F.lit("unassigned")).drop("zone", "ring", "sector")
    inside = zoned.where("zone is not null")
    place = inside.select(*PATCH, "x", "y", "z")
    sizes = place.groupBy(*PATCH).agg(F.count("*").alias("__n"))
    patches = written(sizes.join(seed_heights(place, sensor_height), PATCH, "left").select(*PATCH, "__n", F.coalesce("lpr", F.lit(0.0)).alias("__lpr")), "patches")
    seeds = place.join(patches.where(F.col("__n") > LEAST_POINTS), PATCH).where(F.col("z") < F.col("__lpr") + SEED_HEIGHT)
    near = (F.col("x") - F.col("mx")) * F.col("nx") + (F.col("y") - F.col("my")) * F.col("ny") + (F.col("z") - F.col("mz")) * F.col("nz") < PLANE_DISTANCE
    fitted = planes(seeds)
    for _ in range(ROUNDS - 1):
        again = planes(place.join(fitted, PATCH).where(near).select(*PATCH, "x", "y", "z"))
        # a plane that no point is near to stays
        fitted = written(again.unionByName(fitted.join(again, PATCH, "left_anti")), "planes")
    ring = F.col("ring")
    # the rings nearest to the sensor, counted over all zones, have thresholds
    checked = _by_zone([F.lit(sum(RINGS[:zone])) for zone in range(len(RINGS))]) + ring
    limit = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.least(checked, F.lit(len(values) - 1)).cast("int") + 1)
    flat = F.when((checked < len(ELEVATION)) & (F.col("mz") > limit(ELEVATION)), F.col("flat") < limit(FLATNESS)).otherwise(True)
    upright = fitted.select(*PATCH, *(c for c in _PLANE if c != "flat"), (F.abs("nz") >= UPRIGHT).alias("__up"), flat.alias("__flat"))
    found = inside.join(patches.select(*PATCH, "__n"), PATCH).join(upright, PATCH, "left")
    status = F.when(F.col("__n") <= LEAST_POINTS, "unassigned").when(F.col("__up") & F.col("__flat") & near, "ground").otherwise("in_grid")
    return found.withColumn("status", status).select(*points.columns, "status").unionByName(outside.select(*points.columns, "status"))
