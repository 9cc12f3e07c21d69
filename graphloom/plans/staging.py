"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where that is unset, as in tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        sc.setCheckpointDir(os.path.join("/tmp/checkpoints", uuid.uuid4().hex))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame as Parquet in the shared folder and reads it back: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
