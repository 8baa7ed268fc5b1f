"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the session has no such setting, a local master gets a folder of this machine; elsewhere that is an error, as executors
    would write to different disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder of any file system Spark can reach; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, as any file system Spark can reach gives them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath().toString()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]


class Scratch:
    """Written tables that only the way to a result needs: ``clear`` removes them once the result itself is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


class Rounds(Scratch):
    """The tables of a loop: each round is written, and the one before it is removed, as nothing reads it any more."""

    def write(self, df: DataFrame, name: str = "round") -> DataFrame:
        before, self.paths = self.paths, []
        out = super().write(df, name)
        for path in before:
            remove(self.spark, path)
        return out
