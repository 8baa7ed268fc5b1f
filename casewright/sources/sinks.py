"""Sinks: append-only Parquet tables partitioned by investigation. Merged edges are computed again, never updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..tables import listed, remove


def append(df: DataFrame, folder: str, name: str, by: list[str] | None = None) -> None:
    """Add rows; earlier ones stay as they are. Columns that are new extend the table. A row without an investigation is an error, as no partition can hold it."""
    known = F.when(F.trim("investigation_id") != "", F.col("investigation_id").cast("string")).otherwise(F.raise_error(F.lit("investigation_id is required")))
    df.withColumn("investigation_id", known).write.mode("append").partitionBy("investigation_id", *(by or [])).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, investigation_id: str | None = None) -> DataFrame:
    """A table, or one investigation's partition of it. Ids are texts, whatever they look like: the folders' names alone would make "007" the number 7."""
    merged = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}").schema
    fields = [StructField(f.name, StringType()) if f.name == "investigation_id" else f for f in merged]
    found = spark.read.schema(StructType(fields)).parquet(f"{folder}/{name}")
    return found if investigation_id is None else found.where(F.col("investigation_id") == investigation_id)


def list_events(spark: SparkSession, folder: str, investigation_id: str, name: str = "security_events") -> DataFrame:
    """An investigation's events in order of time."""
    return load(spark, folder, name, investigation_id).orderBy("timestamp", "event_id")


def expired(df: DataFrame, days: int, now: str, column: str = "ingested_at") -> DataFrame:
    """Rows that retention of ``days`` no longer covers at ``now``."""
    return df.where(F.col(column) < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def retained(df: DataFrame, days: int, now: str, column: str = "ingested_at") -> DataFrame:
    return df.where(F.coalesce(F.col(column) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)), F.lit(True)))


def append_by_day(df: DataFrame, folder: str, name: str, column: str = "ingested_at") -> None:
    """Add rows to a table that retention can delete from: partitions of a day each."""
    append(df.withColumn("day", F.to_date(column)), folder, name, ["day"])


def purge(spark: SparkSession, folder: str, name: str, days: int, now: str) -> int:
    """Delete the day partitions that lie wholly before the retention's limit; how many went.

    The folders are taken as the file system lists them, so ids that are written in an escaped form are found too; no file is read.
    """
    limit = spark.range(1).select(F.to_date(F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).cast("string")).first()[0]
    old = [path for path in listed(spark, f"{folder}/{name}/investigation_id=*/day=[0-9]*") if path.rpartition("/day=")[2] < limit]
    return sum(remove(spark, path) for path in old)
