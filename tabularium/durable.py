"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is set, a temporary one, for a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def _path(spark: SparkSession, name: str):
    """(file system, path) of a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def forget_at_exit(spark: SparkSession, name: str) -> str:
    """Have the folder deleted when the application ends; its frames are read lazily until then."""
    files, path = _path(spark, name)
    files.deleteOnExit(path)
    return name


def forget(spark: SparkSession, name: str) -> None:
    """Delete a folder that no frame reads any more."""
    files, path = _path(spark, name)
    files.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read by column. It goes when the application ends."""
    path = forget_at_exit(df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
