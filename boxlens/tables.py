"""Written intermediate tables, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. One is made only where the session names none and is local, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not (base := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="boxlens-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Workspace:
    """Written intermediate tables of one call, in the shared folder. Spark's file system removes them when the application ends; drop() removes one earlier. Under a root of the caller's they stay."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if root is None:
            path = self._path(self.root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it again. Shuffle files that only the write needed go with it."""
        path = f"{self.root}/{name}"
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a plan read, computed once."""
    return Workspace(df.sparkSession, name).write(df, name)
