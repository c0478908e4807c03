"""Tables written to the shared folder: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine, a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most ``n`` rows for the jobs run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def batch_bytes(spark: SparkSession, n: int = 4 << 20):
    """Arrow batches of about ``n`` bytes at most (a longer row is a batch by itself) for the jobs run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n))


class Scratch:
    """Intermediate tables of one operator call, under one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "Scratch":
        """The tables in a folder that is there."""
        out = cls.__new__(cls)
        out.spark, out.root = spark, root.rstrip("/")
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, batch: int = 4 << 20) -> DataFrame:
        """Write ``df`` and return the written table; Spark then removes the shuffle files of that job.  Arrow batches have ``batch`` bytes."""
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), batch_bytes(self.spark, batch):
            df.write.parquet(self.path(name))
        # The session's cache of listings would hold this table's files for as long as the driver lives.
        with setting(self.spark, "spark.sql.hive.filesourcePartitionFileCacheSize", "0"):
            return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
