"""Cutting lineage with written tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a fresh local one, if driver and executors are one
    process; a cluster must name a folder that it shares."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-eventlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _top(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/eventlake/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive the loss of any executor."""
    path = f"{_top(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> bool:
    """Delete all tables that this application has kept so far: for callers whose results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_top(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
