"""Shared helpers: the shared work folder, written intermediate tables and small byte routines."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Conf that the operators need whatever the cluster's defaults are.
SHARED_CONF = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; one is made only where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get(SHARED_CONF, None) or sc.getConf().get(SHARED_CONF)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not sc.master.startswith("local"):
            raise ValueError(f"set {SHARED_CONF} to a folder that the driver and all executors share")
        root = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
        if not known.isDefined():
            sc.setCheckpointDir(root)
    return root if ":/" in root else "file://" + root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root, as a URI."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = pafs.FileSystem.from_uri(path)
    fs.create_dir(p, recursive=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
