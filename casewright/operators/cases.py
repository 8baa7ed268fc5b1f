"""Investigations as an append-only log; the latest row of an id is its state. Also notes, access and error envelopes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OUTCOMES, STATUSES


class EngineError(Exception):
    """An error with its status and code: 400, 401, 403, 404, 409, 422, 500 or 503."""

    CODES = {400: "VALIDATION_ERROR", 401: "UNAUTHENTICATED", 403: "FORBIDDEN", 404: "NOT_FOUND", 409: "CONFLICT", 422: "UNPROCESSABLE", 500: "INTERNAL_ERROR", 503: "UNAVAILABLE"}

    def __init__(self, status: int, message: str, event_id: str | None = None):
        super().__init__(message)
        self.status, self.error, self.message, self.event_id = status, self.CODES[status], message, event_id

    def envelope(self) -> dict:
        return {"status": self.status, "error": self.error, "message": self.message, "event_id": self.event_id}


def require(df: DataFrame, what: str, status: int = 404) -> DataFrame:
    """``df``, or an error if it has no row."""
    if df.isEmpty():
        raise EngineError(status, f"{what} not found" if status == 404 else what)
    return df


def guarded(call: Callable[[], DataFrame], dependency: str) -> DataFrame:
    """What a store or provider returns; its failure is the dependency's (503), not the input's."""
    try:
        return call()
    except EngineError:
        raise
    except Exception as e:
        raise EngineError(503, f"{dependency} is unavailable: {str(e)[:200]}") from e


def opened(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """New cases of rows (investigation_id or null, title, description, created_by). Blank titles are an error."""
    if not rows.where(F.trim(F.coalesce("title", F.lit(""))) == "").isEmpty():
        raise EngineError(400, "title is required")
    now = F.current_timestamp() if at is None else at
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.coalesce(text("investigation_id"), F.uuid()).alias("investigation_id"), "title", text("description").alias("description"), F.lit("OPEN").alias("status"), text("created_by").alias("created_by"),
        F.lit(None).cast("string").alias("outcome"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("closed_at"),
    )


def create(spark: SparkSession, title: str, description: str = "", created_by: str | None = None) -> DataFrame:
    return opened(spark.createDataFrame([(title, description, created_by)], "title string, description string, created_by string"))


def latest(log: DataFrame) -> DataFrame:
    """The state of each case: its latest row. Of rows of one moment the one that is farthest along counts: closed ones, then reviewed ones."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    newest = log.groupBy("investigation_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "investigation_id"]), F.struct("updated_at", stage, "outcome", "title", "description")).alias("row"))
    return newest.select(*[F.col("investigation_id") if c == "investigation_id" else F.col(f"row.{c}").alias(c) for c in log.columns])


def changed(log: DataFrame, changes: DataFrame, at: Column | None = None) -> DataFrame:
    """The rows to append for ``changes`` (investigation_id, and any of title, description, status, outcome; nulls change nothing).

    Values outside their enumerations and blank titles are an error (400), cases that aren't in the log one of 404.
    """
    at = F.current_timestamp() if at is None else at
    known = {"status": STATUSES, "outcome": OUTCOMES}
    names = [c for c in ("title", "description", "status", "outcome") if c in changes.columns]
    wrong = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (~F.col(c).isin(known[c]) if c in known else F.trim(c) == "") for c in names if c != "description"], F.lit(False))
    if not changes.where(wrong).isEmpty():
        raise EngineError(400, "unknown status or outcome, or a blank title")
    state = latest(log)
    if not changes.join(state, "investigation_id", "left_anti").isEmpty():
        raise EngineError(404, "no such investigation")
    fresh = changes.select("investigation_id", *[F.col(c).alias(f"new_{c}") for c in names])
    out = state.join(fresh, "investigation_id").withColumns({c: F.coalesce(f"new_{c}", F.col(c)) for c in names}).withColumn("updated_at", at)
    if "status" in names:
        out = out.withColumn("closed_at", F.when(F.col("new_status") == "CLOSED", at).when(F.col("new_status").isNotNull(), F.lit(None)).otherwise(F.col("closed_at")))
    return out.select(*log.columns)


def change(log: DataFrame, investigation_id: str, at: Column | None = None, **values: str) -> DataFrame:
    """The row to append for changed title, description, status or outcome of one case."""
    spark = log.sparkSession
    row = spark.createDataFrame([(investigation_id, *values.values())], ", ".join(f"{c} string" for c in ("investigation_id", *values)))
    return changed(log, row, at)


def noted(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Analysts' notes of rows (investigation_id, note, author), in a table apart from generated text."""
    return rows.select("investigation_id", "note", "author", F.lit("analyst").alias("kind"), (F.current_timestamp() if at is None else at).alias("noted_at"))


def note(spark: SparkSession, investigation_id: str, text: str, author: str) -> DataFrame:
    return noted(spark.createDataFrame([(investigation_id, text, author)], "investigation_id string, note string, author string"))


def visible(df: DataFrame, grants: DataFrame, user: str | None) -> DataFrame:
    """Rows of the investigations that ``grants`` (user, investigation_id) give to a user. No user at all is an error."""
    if not user:
        raise EngineError(401, "no user")
    return df.join(grants.where(F.col("user") == user).select("investigation_id").distinct(), "investigation_id", "left_semi")


def authorized(grants: DataFrame, user: str | None, investigation_id: str) -> None:
    """An error unless the user may see the investigation."""
    if not user:
        raise EngineError(401, "no user")
    if grants.where((F.col("user") == user) & (F.col("investigation_id") == investigation_id)).isEmpty():
        raise EngineError(403, "no access to this investigation")
