"""Evidence of entities and relationships in segments, so that no row grows with how often something is seen.

``segments`` is the first level: for each key (an entity, an edge) and bucket of time, rows of about ``size`` event ids at most; a bucket that has
more is cut into parts by the ids' hash. ``heads`` is the second level: a row for each key with its counts and times, made of the segments
without their lists. Lists are opened by joining: ``events_of``. Counting and cutting are map-side combined, and no group of a whole hub is gathered.

Defined results: an event counts once for a key, however many rows name it; rows without an event id or time give nothing; no rows, no segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = ["investigation_id", "entity_type", "entity_key"]
EDGE = ["investigation_id", "relationship_type", "src_type", "src_key", "dst_type", "dst_key"]
SIZE = 1_000


def segments(rows: DataFrame, keys: list[str], size: int = SIZE, span_seconds: int = 86_400) -> DataFrame:
    """``keys, bucket, part, n, first_seen, last_seen, event_ids`` of rows (keys, event_id or event_ids, timestamp)."""
    ids = F.explode("event_ids") if "event_ids" in rows.columns else F.col("event_id")
    each = rows.where(F.col("timestamp").isNotNull()).select(*keys, "timestamp", ids.alias("event_id")).where(F.col("event_id").isNotNull())
    # of an event's rows the earliest time is the event's
    each = each.groupBy(*keys, "event_id").agg(F.min("timestamp").alias("timestamp")).withColumn("bucket", F.floor(F.unix_seconds("timestamp") / span_seconds))
    large = each.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).where(F.col("n") > size).select(*keys, "bucket", F.ceil(F.col("n") / size).alias("parts"))
    cut = each.join(large, [*keys, "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("event_id"), F.coalesce("parts", F.lit(1).cast("bigint"))))
    return cut.groupBy(*keys, "bucket", "part").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.array_sort(F.collect_list("event_id")).alias("event_ids"))


def heads(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_events, n_segments, largest, first_seen, last_seen``; over a written table of segments the lists aren't read."""
    return found.groupBy(*keys).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_segments"), F.max("n").alias("largest"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def events_of(found: DataFrame, keys: list[str], asked: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """``keys, event_id`` of the segments, of the ``asked`` keys and of times that can lie between ``start`` and ``end``."""
    if start is not None:
        found = found.where(F.col("last_seen") >= F.lit(start).cast("timestamp"))
    if end is not None:
        found = found.where(F.col("first_seen") <= F.lit(end).cast("timestamp"))
    if asked is not None:
        found = found.join(asked.select(*keys).distinct(), keys, "left_semi")
    return found.select(*keys, F.explode("event_ids").alias("event_id"))
