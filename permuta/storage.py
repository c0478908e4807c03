"""Cutting lineage with reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_root(spark: SparkSession) -> str | None:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet, below ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs on one machine."""
    root = _checkpoint_root(spark) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so it survives lost executors.

    The folder is the one the session names in ``spark.checkpoint.dir``; a local one is set only where it isn't and Spark runs on one machine.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_checkpoint_root(df.sparkSession) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
