"""Checkpoints in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The context's folder, or spark.checkpoint.dir; a temporary folder only where driver and executors are one process."""
    context = spark.sparkContext
    java = context._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return java.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="huegrid-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), into the folder of checkpoint_dir."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()
