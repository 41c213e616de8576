"""The shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder the cluster names in spark.checkpoint.dir.

    Only on a local master, where driver and tasks share one disk, a temporary folder stands in
    for a missing setting; elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {master})")
        root = tempfile.mkdtemp(prefix="fieldtide-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder below the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and stored where it outlives the executors."""
    shared_root(df.sparkSession)
    return df.checkpoint()
