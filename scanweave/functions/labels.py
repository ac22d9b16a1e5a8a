"""Labels, classes and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BUILDING, BUILDING_TYPE, CAR_TYPE, DYNAMIC, GROUND, MOVING, TREE, TREE_TYPE, UNLABELLED


def semantic(label: Column) -> Column:
    return label.bitwiseAND(65535)


def instance(label: Column) -> Column:
    return F.shiftright(label, 16)


def labelled(label: Column) -> Column:
    return ~semantic(label).isin(*UNLABELLED)


def dynamic(sem: Column) -> Column:
    return sem.isin(*DYNAMIC)


def coarse_class(sem: Column) -> Column:
    """ground 40, building 50, tree 70, everything else 0."""
    return F.when(sem.isin(*GROUND), 40).when(sem.isin(*BUILDING), 50).when(sem.isin(*TREE), 70).otherwise(0)


def colour(kind: Column) -> Column:
    """(r, g, b) of a coarse class."""
    # fixed values: the colours of the class maps
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return F.when(kind == 40, rgb(128, 128, 128)).when(kind == 50, rgb(0, 0, 255)).when(kind == 70, rgb(0, 255, 0)).otherwise(rgb(255, 0, 0))


def object_colour(kind: Column, state: Column) -> Column:
    """(r, g, b) of a segmented object: moving ones red, then by type; null (a colour of its own) for cars at rest."""
    # fixed values: the colours of the segmented clouds
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return F.when(state == MOVING, rgb(255, 0, 0)).when(kind == BUILDING_TYPE, rgb(139, 90, 0)).when(kind == TREE_TYPE, rgb(162, 205, 90)).when((kind == CAR_TYPE) | (kind == -1), F.lit(None)).otherwise(rgb(255, 255, 255))


def residue_colour(sem: Column) -> Column:
    """(r, g, b) of a point that an estimate kept: what should have gone is red."""
    # fixed values: the colours of the residue maps
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return F.when(dynamic(sem), rgb(255, 0, 0)).otherwise(rgb(205, 192, 176))


def class_of_colour(r: Column, g: Column, b: Column) -> Column:
    """The coarse class that a colour stands for."""
    return F.when((r == 128) & (g == 128) & (b == 128), 40).when((r == 0) & (g == 0) & (b == 255), 50).when((r == 0) & (g == 255) & (b == 0), 70).otherwise(0)
