"""Shared storage: the cluster's folder and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    return root


def _own_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the tables that ``cut`` has written in this application; results that are not stored yet can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The lineage cut: written as Parquet to the shared folder and read back, with statistics; each is computed once."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of jobs that are over; else they stay on the
    executors' disks until it happens to. For after a large table's cut, when what it was made of is not read again."""
    spark._jvm.System.gc()


def cut_counting(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and how many rows meet each condition, counted as they are written (a task that runs twice counts twice, so
    only whether there are any is exact)."""
    seen = Observation()
    out = cut(df.observe(seen, *(F.count(F.when(c, 1)).alias(k) for k, c in conditions.items())))
    return out, seen.get
