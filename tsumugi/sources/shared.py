"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the cluster names; a temporary folder where it is unset on a local master (tests)."""
    context = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if own is None and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="tsumugi-"))
    return own or context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_top(spark).rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder (checkpoint); Spark's cleaner removes it where that is switched on."""
    shared_top(df.sparkSession)
    return df.checkpoint(eager=True)
