"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STAGED: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local master gets a folder of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scanweave-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost only their own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scanweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(df: DataFrame) -> tuple:
    """(path, bytes, time of change) of every file that df reads: other data in the same place has other values."""
    spark, out = df.sparkSession, []
    for f in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def staged(label: str, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a table of this application, written once for each state of source's files and read by all that ask
    again; make() must depend on nothing else."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, label, files_of(source))
    if key not in _STAGED:
        _STAGED[key] = written(make(), label)
    df = _STAGED[key]
    return df if df.sparkSession is spark else spark.read.schema(df.schema).parquet(*df.inputFiles())


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`, the place of each row in its group by `order`, from 0. No group meets in one task.

    Rows go to ranges of (group, order) and are written; what is counted is each task's rows per group, and what is broadcast a
    row for each of these.
    """
    placed = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    runs = placed.groupBy(*group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(*group, "__part", (before - F.col("__first")).alias("__offset"))
    return placed.withColumn("__part", part).join(starts, [*group, "__part"]).withColumn(name, F.col("__at") + F.col("__offset")).drop("__at", "__part", "__offset")
