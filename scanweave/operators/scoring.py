"""Scores of an estimated cloud against a labelled one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DYNAMIC
from ..functions.labels import dynamic, instance, semantic
from .spatial import with_near


def class_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("sem").agg(F.count("*").alias("n"))


def static_and_dynamic(points: DataFrame) -> DataFrame:
    """One row: static, dynamic and total points, and dynamic per hundred static ones."""
    one = points.agg(F.count_if(~dynamic(F.col("sem"))).alias("n_static"), F.count_if(dynamic(F.col("sem"))).alias("n_dynamic"), F.count("*").alias("n_total"))
    return one.withColumn("percentage", F.col("n_dynamic") * 100.0 / F.nullif("n_static", F.lit(0)))


def class_rejection(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """(sem, n_truth, n_estimate, rejection) of every dynamic class; rejection is null where there was nothing to reject."""
    spark = truth.sparkSession
    classes = spark.createDataFrame([(c,) for c in DYNAMIC], "sem int")
    a, b = class_counts(truth).withColumnRenamed("n", "a"), class_counts(estimate).withColumnRenamed("n", "b")
    joined = classes.join(a, "sem", "left").join(b, "sem", "left").select("sem", F.coalesce("a", F.lit(0)).alias("n_truth"), F.coalesce("b", F.lit(0)).alias("n_estimate"))
    return joined.withColumn("rejection", (F.col("n_truth") - F.col("n_estimate")) * 100.0 / F.nullif("n_truth", F.lit(0)))


def count_scores(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """One row: precision and recall of the removal of dynamic points, by counts alone; null where nothing was there to remove."""
    a = static_and_dynamic(truth).select(F.col("n_dynamic").alias("d"), F.col("n_total").alias("t"))
    b = static_and_dynamic(estimate).select(F.col("n_dynamic").alias("e"), F.col("n_total").alias("u"))
    gone = F.col("d") - F.col("e")
    return a.crossJoin(b).select((gone * 1.0 / F.nullif(F.col("t") - F.col("u"), F.lit(0))).alias("precision"), (gone * 1.0 / F.nullif("d", F.lit(0))).alias("recall"))  # two rows of one


def inlier_distance(voxel_size: float) -> float:
    return voxel_size * math.sqrt(3) / 2


def preservation(matched: DataFrame) -> DataFrame:
    """One row of preservation, rejection and F1 from (sem, weight, near_sem), near_sem null where nothing was in reach."""
    w, own, other = F.col("weight"), dynamic(F.col("sem")), F.coalesce(dynamic(F.col("near_sem")), F.lit(None).cast("boolean"))
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    one = matched.agg(total(~own).alias("n_static"), total(own).alias("n_dynamic"), total(~own & ~other).alias("kept_static"), total(own & other).alias("kept_dynamic"))
    pr = F.col("kept_static") * 100.0 / F.nullif("n_static", F.lit(0))
    rr = (F.col("n_dynamic") - F.col("kept_dynamic")) * 100.0 / F.nullif("n_dynamic", F.lit(0))
    return one.withColumns({"pr": pr, "rr": rr}).withColumn("f1", 2 * (F.col("pr") / 100) * (F.col("rr") / 100) / F.nullif((F.col("pr") + F.col("rr")) / 100, F.lit(0.0)))


#: Metres within which a point counts as the same one; a fixed value.
SAME_POINT = 0.01


def exact_inliers(matched: DataFrame) -> DataFrame:
    """One row: points, those with a point of the estimate at their place, and those of them that are static in both clouds.

    matched: (sem, weight, near_sem), near_sem null where no point is nearer than SAME_POINT.
    """
    w, there = F.col("weight"), F.col("near_sem").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    static = ~dynamic(F.col("sem")) & ~dynamic(F.col("near_sem"))
    return matched.agg(total(F.lit(True)).alias("n_points"), total(there).alias("preserved"), total(there & static).alias("static_in_both"))


def alike(a: Column, b: Column) -> Column:
    """Equal classes; building and tree count as each other's hit."""
    return (a == b) | (a.isin(50, 70) & b.isin(50, 70))


def transferred_labels(points: DataFrame, truth: DataFrame, radius: float, on: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """points with `label`, that of the nearest labelled point within the radius; points with none in reach are left out.

    truth: on, x, y, z, label, and the columns of `order`, named r_<column> there, which settle equal distances.
    """
    found = with_near(points, truth, radius, on, order, ["label"]).where("near is not null")
    return found.select(*points.columns, F.col("near.r_label").alias("label"))


def without_class(labelled: DataFrame, sem: int) -> DataFrame:
    """Points whose label is of another class."""
    return labelled.where(semantic(F.col("label")) != sem)


def instance_ids(labelled: DataFrame, classes: tuple[int, ...] = DYNAMIC, error: float = 0.05) -> DataFrame:
    """(sem, n, ids, about): points, exact and sketched numbers of distinct instances, for each class that occurs.

    The exact number is counted over distinct (class, instance) rows, so no set is held anywhere; `about` comes from a
    mergeable sketch in the same pass over these, with the relative standard error asked for.
    """
    one = labelled.select(semantic(F.col("label")).cast("int").alias("sem"), instance(F.col("label")).alias("inst")).where(F.col("sem").isin(*classes))
    per = one.groupBy("sem", "inst").agg(F.count("*").alias("k"))
    return per.groupBy("sem").agg(F.sum("k").alias("n"), F.count("inst").alias("ids"), F.approx_count_distinct("inst", error).alias("about"))
