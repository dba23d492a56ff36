"""Where lineage is cut: checkpoints in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which all executors share.

    The folder is ``spark.checkpoint.dir``; only a local session that names none gets one of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder."""
    scratch_path(df.sparkSession, "")
    return df.checkpoint()
