"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Rounds, Scratch, shared_path
from ..tables import written as materialize

__all__ = ["BATCH_BYTES", "BLANKS", "BLANK_RUN", "Rounds", "Scratch", "bounded_batches", "fold", "materialize", "shared_path", "table", "words"]

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: Spark's name for the most bytes of an Arrow batch on its way to Python; its own default is 64 MB.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "2m") -> None:
    """Let texts go to Python in Arrow batches of about ``most``, for this session from now on, unless it has a bound of its own.

    Else a task's whole texts of up to 10,000 rows are one batch, held in buffers of the JVM that double as they grow, and again as Arrow, pandas
    and Python objects in a worker that keeps the memory. Which rows share a batch changes no result.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
