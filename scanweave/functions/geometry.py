"""Geometry as column expressions: everything stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df.withColumns(columns), each value computed once for a row.

    As the output of a generator, they are not copied into every expression and filter that uses them: chains of coordinates
    would grow with each step, beyond what Spark compiles.
    """
    order = list(dict.fromkeys((*df.columns, *columns)))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(v.alias(c) for c, v in columns.items()))))).select(*order)


def planar_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def polar_angle(x: Column, y: Column) -> Column:
    """Degrees from the x axis, 0 to 360; 0 at the origin."""
    turned = F.when(y >= 0, F.atan2(y, x)).otherwise(F.atan2(y, x) + 2 * math.pi)
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(turned * 180.0 / math.pi)


def elevation(x: Column, y: Column, z: Column) -> Column:
    """Degrees above the xy plane."""
    return F.atan2(z, planar_range(x, y)) * 180.0 / math.pi


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """The nine entries, by rows, of Rz(yaw) Ry(pitch) Rx(roll)."""
    a, b, c, d, e, f = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return [a * c, a * d * f - b * e, b * f + a * d * e, b * c, a * e + b * d * f, b * d * e - a * f, -d, c * f, c * e]


def euler(r: list[Column]) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw) of a rotation given by rows; near the pole yaw is zero."""
    sy = F.sqrt(r[0] * r[0] + r[3] * r[3])
    pole = sy < 1e-6
    return F.when(pole, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8])), F.atan2(-r[6], sy), F.when(pole, F.lit(0.0)).otherwise(F.atan2(r[3], r[0]))


def apply(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """R p + t."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def invert(r: list[Column], t: list[Column]) -> tuple[list[Column], list[Column]]:
    """The inverse of a rigid transform: transposed rotation, turned-back translation."""
    back = [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]
    return back, [-x for x in apply(back, [F.lit(0.0)] * 3, t)]


def compose(r1: list[Column], t1: list[Column], r2: list[Column], t2: list[Column]) -> tuple[list[Column], list[Column]]:
    """First the second transform, then the first."""
    r = [sum((r1[3 * i + k] * r2[3 * k + j] for k in range(1, 3)), r1[3 * i] * r2[j]) for i in range(3) for j in range(3)]
    return r, apply(r1, t1, t2)


def quaternion(r: list[Column]) -> list[Column]:
    """(x, y, z, w) with w >= 0, from a rotation by rows."""
    half = lambda v: F.sqrt(F.greatest(F.lit(0.0), v)) / 2
    signed = lambda v, s: F.when(s < 0, -half(v)).otherwise(half(v))
    return [signed(1 + r[0] - r[4] - r[8], r[7] - r[5]), signed(1 - r[0] + r[4] - r[8], r[2] - r[6]), signed(1 - r[0] - r[4] + r[8], r[3] - r[1]), half(1 + r[0] + r[4] + r[8])]


def weighted_l1(a: Column, b: Column, weights: list[float]) -> Column:
    """Sum of weighted absolute differences of two arrays over the first len(weights) places."""
    w = F.array(*map(F.lit, weights))
    gaps = F.zip_with(F.slice(a, 1, len(weights)), F.slice(b, 1, len(weights)), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(F.zip_with(gaps, w, lambda g, k: g * k), F.lit(0.0), lambda total, v: total + v)


def eigenvalues3(df: DataFrame, entries: tuple[str, ...] = ("xx", "xy", "xz", "yy", "yz", "zz"), names: tuple[str, str, str] = ("e1", "e2", "e3")) -> DataFrame:
    """df with the eigenvalues, descending, of the symmetric 3x3 matrix in its columns `entries`, in closed form.

    The matrix less its mean eigenvalue, scaled, has a determinant whose half is the cosine of three times an angle; the
    eigenvalues are cosines of that angle and of the two a third of a turn away. Negative values of rounding are zero, so the
    matrix should be one of moments. A null entry makes all null.
    """
    xx, xy, xz, yy, yz, zz = map(F.col, entries)
    whole = (xx + yy + zz) / 3
    out = df.withColumn("__q", whole)
    q = F.col("__q")
    off = xy * xy + xz * xz + yz * yz
    out = out.withColumn("__p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6))
    p = F.col("__p")
    determinant = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    half = F.when(p > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), determinant / (2 * p * p * p)))).otherwise(0.0)
    out = out.withColumn("__t", F.acos(half) / 3)
    t = F.col("__t")
    out = out.withColumns({names[0]: q + 2 * p * F.cos(t), "__least": q + 2 * p * F.cos(t + 2 * math.pi / 3)})
    least = F.when(F.col("__least") < 0, 0.0).otherwise(F.col("__least"))
    out = out.withColumns({names[2]: least, "__middle": 3 * q - F.col(names[0]) - F.col("__least")})
    return out.withColumn(names[1], F.when(F.col("__middle") < F.col(names[2]), F.col(names[2])).otherwise(F.col("__middle"))).drop("__q", "__p", "__t", "__least", "__middle")


def axis3(df: DataFrame, value: str, entries: tuple[str, ...] = ("xx", "xy", "xz", "yy", "yz", "zz"), names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """df with the unit eigenvector of a simple eigenvalue: the longest cross product of two rows of the matrix less it.

    Null where all cross products vanish, as they do for eigenvalues that are not simple. The sign is that of the product.
    """
    xx, xy, xz, yy, yz, zz = map(F.col, entries)
    e = F.col(value)
    rows = ((xx - e, xy, xz), (xy, yy - e, yz), (xz, yz, zz - e))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    products = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    fields = lambda c: F.struct((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("l"), c[0].alias("x"), c[1].alias("y"), c[2].alias("z"))
    out = df.withColumn("__c", F.greatest(*(fields(c) for c in products)))
    length = F.sqrt(F.col("__c.l"))
    return out.withColumns({n: F.when(length > 0, F.col(f"__c.{c}") / length) for n, c in zip(names, "xyz")}).drop("__c")
