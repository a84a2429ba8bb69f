"""Intermediate tables: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, one of our own, but only if driver and executors are one machine's process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def frozen(df: DataFrame) -> DataFrame:
    """df as it is now: later changes of its sources don't reach it, nothing is computed again."""
    path = f"{shared_folder(df.sparkSession)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
