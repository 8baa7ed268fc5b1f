"""Timelines and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REF = ["relationship_type", "src_key", "dst_key"]


def edge_ref() -> Column:
    return F.concat(F.col("src_key"), F.lit(" -"), F.col("relationship_type"), F.lit("-> "), F.col("dst_key"))


def timeline(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Each event with references to its edges, a source row of the timeline. Order it by ``timestamp, event_id``."""
    refs = edges.select("investigation_id", F.explode("event_ids").alias("event_id"), edge_ref().alias("ref")).groupBy("investigation_id", "event_id").agg(F.array_sort(F.collect_set("ref")).alias("relationship_refs"))
    rows = events.select("investigation_id", "timestamp", "event_id", "event_type", "action", "user", "source_host", "destination_host", "process", "file", F.col("source_name").alias("source"), F.lit("event").alias("kind"))
    return rows.join(refs, ["investigation_id", "event_id"], "left").withColumn("relationship_refs", F.coalesce("relationship_refs", F.array().cast("array<string>")))


def with_derived(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Timeline rows and, marked as such, the derived edges."""
    extra = edges.where("derived").select("investigation_id", "timestamp", "event_id", F.col("relationship_type").alias("event_type"), F.lit("derived").alias("action"), "source", F.lit("derived").alias("kind"), F.array(edge_ref()).alias("relationship_refs"))
    return rows.unionByName(extra, allowMissingColumns=True)


def with_narrative(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Timeline rows and the summaries made of them (``context.audit``), marked as generated text: they are no evidence."""
    extra = summaries.where("status = 'available'").select("investigation_id", F.col("made_at").alias("timestamp"), F.lit("summary").alias("event_type"), F.lit("narrative").alias("action"), F.col("provider").alias("source"), F.lit("narrative").alias("kind"))
    return rows.unionByName(extra, allowMissingColumns=True)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("timestamp", "event_id", "kind")


def select(rows: DataFrame, start: str | None = None, end: str | None = None, event_types: list[str] | None = None, actions: list[str] | None = None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if event_types:
        rows = rows.where(F.col("event_type").isin(event_types))
    return rows.where(F.col("action").isin(actions)) if actions else rows


def of_entity(rows: DataFrame, occurrences: DataFrame, key: str) -> DataFrame:
    return rows.join(occurrences.where(F.col("entity_key") == key).select("investigation_id", "event_id"), ["investigation_id", "event_id"], "left_semi")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Activity of each user without a gap of that length: start, last event and count."""
    s = events.where(F.col("user").isNotNull()).groupBy("investigation_id", F.lower("user").alias("user_key"), F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("n"), F.max("timestamp").alias("last_seen"))
    return s.select("investigation_id", "user_key", F.col("w.start").alias("first_seen"), "last_seen", "n")


def adjacent(events: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """Each event with the one before and after it in its investigation's user activity. Events without a user have neither and are spread over the tasks.

    A busy user is spread over spans of time: neighbours are found within a span, and the first and last events of the spans, a row each, tell
    what lies across their borders.
    """
    keys = ["investigation_id", "__user", "__spread", "__span"]
    rows = events.select("investigation_id", "event_id", "timestamp", F.lower("user").alias("__user"), F.when(F.col("user").isNull(), F.xxhash64("event_id")).otherwise(0).alias("__spread"), F.coalesce(F.floor(F.unix_seconds("timestamp") / span_seconds), F.lit(-1).cast("bigint")).alias("__span"))
    rows = rows.withColumn("__user", F.coalesce("__user", F.lit("")))
    place = F.struct("timestamp", "event_id")
    ends = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    across = Window.partitionBy(*keys[:3]).orderBy("__span")
    ends = ends.select(*keys, F.lag("last.event_id").over(across).alias("__before"), F.lead("first.event_id").over(across).alias("__after"))
    w = Window.partitionBy(*keys).orderBy("timestamp", "event_id")
    found = rows.withColumns({"before": F.lag("event_id").over(w), "after": F.lead("event_id").over(w)}).join(ends, keys)
    return found.select("investigation_id", "event_id", F.coalesce("before", "__before").alias("before"), F.coalesce("after", "__after").alias("after"))


def edge_evidence(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Each edge with each of its supporting events."""
    each = edges.select("investigation_id", *REF, "derived", F.explode("event_ids").alias("event_id"))
    return each.join(events.select("investigation_id", "event_id", "timestamp", "action"), ["investigation_id", "event_id"])


def event_edges(edges: DataFrame) -> DataFrame:
    """Which edges an event supports."""
    return edges.select("investigation_id", F.explode("event_ids").alias("event_id"), *REF, "derived")


def node_events(events: DataFrame, occurrences: DataFrame, key: str) -> DataFrame:
    return of_entity(events, occurrences, key)


def untraceable(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edge references to events that aren't there; must be empty."""
    return event_edges(edges).join(events.select("investigation_id", "event_id"), ["investigation_id", "event_id"], "left_anti")


def details(events: DataFrame, occurrences: DataFrame, edges: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """All that is known of each event, as a nested row: its entities, relationships and, where they are given, correlations."""
    keys = ["investigation_id", "event_id"]
    of = occurrences.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("entity_type", "entity_key", "role"))).alias("entities"))
    rel = event_edges(edges).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*REF, "derived"))).alias("relationships"))
    found = events.join(of, keys, "left").join(rel, keys, "left")
    if correlations is None:
        return found
    pairs = correlations.where("related").select("investigation_id", "event_a", "event_b", "signals", F.explode(F.array("event_a", "event_b")).alias("event_id"))
    cor = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("event_a", "event_b", "signals"))).alias("correlations"))
    return found.join(cor, keys, "left")


def correlation_counts(correlations: DataFrame) -> DataFrame:
    """How many related pairs each event is in. Pairs are counted where they are found, so no list of them grows with a busy bucket."""
    pairs = correlations.where("related").select("investigation_id", F.explode(F.array("event_a", "event_b")).alias("event_id"))
    return pairs.groupBy("investigation_id", "event_id").agg(F.count("*").alias("n_correlations"))


def detail(event_id: str, events: DataFrame, occurrences: DataFrame, edges: DataFrame, correlations: DataFrame) -> DataFrame:
    """``details`` of one event; the conditions go before the grouping."""
    has = F.array_contains("event_ids", event_id)
    pairs = correlations.where((F.col("event_a") == event_id) | (F.col("event_b") == event_id))
    one = F.col("event_id") == event_id
    return details(events.where(one), occurrences.where(one), edges.where(has), pairs).where(one)
