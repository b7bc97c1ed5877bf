"""Scratch space that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = found or "/tmp/checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to spark.checkpoint.dir; its lineage ends there. Where it is unset, local mode uses a folder under /tmp, and a cluster is an error."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, under the same rules as settled()."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again with its own column order."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
