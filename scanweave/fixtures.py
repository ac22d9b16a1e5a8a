"""A synthetic scene: lineitem as labelled point clouds of seven frames, in integer millimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.tables import staged

_MM = """
select cast(l_linenumber - 1 as int) frame_id, cast(l_suppkey as bigint) obj_id, cast(l_orderkey as bigint) scan_key, cast(l_partkey as bigint) beam,
       case when l_returnflag = 'N' then 40 when l_suppkey % 5 = 0 then 252 when l_suppkey % 5 = 1 then 50 when l_suppkey % 5 = 2 then 70 else 10 end sem,
       case when l_returnflag = 'N' then ((l_partkey*7919 + l_orderkey*31) % 56001) - 28000
            else ((l_suppkey*37) % 48 - 24)*1000 + ((l_partkey*13 + l_orderkey*7) % 1800) + case when l_suppkey % 5 = 0 then (l_linenumber - 1)*1500 else 0 end end x_mm,
       case when l_returnflag = 'N' then ((l_partkey*104729 + l_orderkey*17) % 56001) - 28000
            else ((l_suppkey*53) % 46 - 23)*1000 + ((l_partkey*29 + l_orderkey*11) % 1700) end y_mm,
       case when l_returnflag = 'N' then -1730 + (l_partkey % 40)
            else -1500 + (l_orderkey*19 + l_partkey*23) % (case when l_suppkey % 5 = 1 then 5000 when l_suppkey % 5 = 2 then 3500 else 1500 end) end z_mm,
       cast(l_discount*1000 as bigint) + cast(l_quantity as bigint) refl
from {lineitem}
"""

SPARK_POINTS = f"select *, x_mm/1000D x, y_mm/1000D y, z_mm/1000D z from ({_MM}) q"
DUCK_POINTS = f"select *, x_mm/1000::double x, y_mm/1000::double y, z_mm/1000::double z from ({_MM.format(lineitem='lineitem')}) q"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points() as a plan, for what reads the scene once and stores its own part."""
    return spark.sql(SPARK_POINTS.format(lineitem="{items}"), items=lineitem(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, obj_id, scan_key, beam, sem, x_mm, y_mm, z_mm, refl, x, y, z), stored once: scans are data, not a plan."""
    return staged("scene", lineitem(spark, sf_dir), lambda: raw_points(spark, sf_dir))


def poses(spark: SparkSession, frames: int = 7) -> DataFrame:
    """(frame_id, px, py, pz, roll, pitch, yaw): a slow curve; one row per frame."""
    return spark.range(frames).selectExpr("cast(id as int) frame_id", "id * 0.5D px", "id * -0.25D py", "0.1D * id pz", "0.01D * id roll", "-0.02D * id pitch", "0.05D * id yaw")
