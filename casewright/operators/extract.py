"""Entities and relationships of events; each row names the events that support it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as f
from ..schema import RULES, Rules


def with_roles(events: DataFrame, roles: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """Add ``source_type_of`` and ``destination_type_of``: Host or Server, from ``roles`` (host, role) or the name's pattern."""
    out = events
    for side, name in (("source_host", "source_type_of"), ("destination_host", "destination_type_of")):
        guess = f.host_type(F.col(side), rules.server_pattern)
        if roles is not None:
            known = roles.select(rules.identity.host(F.col("host")).alias("__host"), F.col("role").alias("__role")).dropDuplicates(["__host"])
            out = out.join(known, rules.identity.host(F.col(side)) == F.col("__host"), "left").withColumn(name, F.coalesce("__role", guess)).drop("__host", "__role")
        else:
            out = out.withColumn(name, guess)
    return out


def _entity(kind: Column | str, key: Column, name: Column, role: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("entity_type"), key.alias("entity_key"), name.alias("name"), F.lit(role).alias("role"))


def occurrences(events: DataFrame, roles: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """One row for each entity that an event names; missing fields make none."""
    c = F.col
    found = F.array(
        _entity("User", rules.identity.user(c("user")), c("user"), "user"),
        _entity(c("source_type_of"), rules.identity.host(c("source_host")), c("source_host"), "source_host"),
        _entity(c("destination_type_of"), rules.identity.host(c("destination_host")), c("destination_host"), "destination_host"),
        _entity("IP", c("source_ip"), c("source_ip"), "source_ip"),
        _entity("IP", c("destination_ip"), c("destination_ip"), "destination_ip"),
        _entity("Process", rules.identity.process(c("source_host"), c("process")), f.base_name(c("process")), "process"),
        _entity("File", rules.identity.file(c("file")), c("file"), "file"),
    )
    rows = with_roles(events, roles, rules).select("investigation_id", "event_id", "timestamp", F.inline(F.filter(found, lambda x: x["entity_key"].isNotNull())))
    return rows


def entities(found: DataFrame) -> DataFrame:
    """One row for each entity of an investigation, with its events."""
    return found.groupBy("investigation_id", "entity_type", "entity_key").agg(
        F.min_by("name", F.struct("timestamp", "event_id")).alias("name"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct("event_id").alias("n_events"),
        F.array_sort(F.collect_set("event_id")).alias("event_ids"),
    )


def _edge(when: Column, kind: str, src_type: Column | str, src: Column, dst_type: Column | str, dst: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    edge = F.struct(F.lit(kind).alias("relationship_type"), lit(src_type).alias("src_type"), src.alias("src_key"), lit(dst_type).alias("dst_type"), dst.alias("dst_key"))
    return F.when(when & src.isNotNull() & dst.isNotNull(), edge)


def observations(events: DataFrame, roles: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """Edges that single events state. Events that fit no rule make none."""
    c = F.col
    does = lambda a: F.lower("action") == a
    source, target = rules.identity.host(c("source_host")), rules.identity.host(F.coalesce("destination_host", "source_host"))
    target_type = F.when(c("destination_host").isNotNull(), c("destination_type_of")).otherwise(c("source_type_of"))
    far = F.coalesce(rules.identity.host(c("destination_host")), c("destination_ip"))
    far_type = F.when(c("destination_host").isNotNull(), c("destination_type_of")).otherwise(F.lit("IP"))
    process = rules.identity.process(c("source_host"), c("process"))
    edges = F.array(
        _edge(does("login"), "LOGGED_INTO", "User", rules.identity.user(c("user")), target_type, target),
        _edge(does("authenticate"), "AUTHENTICATED_TO", "User", rules.identity.user(c("user")), target_type, target),
        _edge(does("execute"), "EXECUTED", c("source_type_of"), source, "Process", process),
        _edge(does("connect"), "CONNECTED_TO", c("source_type_of"), source, far_type, far),
        _edge(does("connect"), "CONNECTED_TO", "Process", process, far_type, far),
        _edge(does("access"), "ACCESSED", c("source_type_of"), source, "File", rules.identity.file(c("file"))),
    )
    rows = with_roles(events, roles, rules).select("investigation_id", "event_id", "timestamp", F.col("source_name").alias("source"), F.inline(F.array_compact(edges)))
    return rows.withColumn("event_ids", F.array("event_id")).withColumn("derived", F.lit(False)).withColumn("correlation_signals", F.array().cast("array<string>"))


def derived_edges(events: DataFrame, roles: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """Process to destination, where a connection names no process: the last execution on its host within the window, as of then.

    A range frame over (investigation, host, time bucket) finds it in one pass, without a join. Buckets are as long as the
    window, and an execution stands in its own and the next one, so that a busy host is spread over its buckets. The frame begins
    with the bucket, as the latest execution of a growing frame is kept and not sought again for each row; one that is too old is
    dropped after it.
    """
    c = F.col
    micros = F.unix_micros("timestamp")
    window = rules.window_seconds * 1_000_000
    bucket = F.floor(micros / window)
    frame = Window.partitionBy("investigation_id", rules.identity.host(c("source_host")), "bucket").orderBy(micros).rangeBetween(Window.unboundedPreceding, 0)
    executed = F.when((F.lower("action") == "execute") & c("process").isNotNull(), F.struct("timestamp", "event_id", rules.identity.process(c("source_host"), c("process")).alias("process")))
    found = with_roles(events, roles, rules).where(F.lower("action").isin("execute", "connect") & c("source_host").isNotNull())
    found = found.withColumn("bucket", F.explode(F.when(F.lower("action") == "execute", F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    seen = found.withColumn("last", F.max(executed).over(frame)).where(micros - F.unix_micros("last.timestamp") <= window)
    far = F.coalesce(rules.identity.host(c("destination_host")), c("destination_ip"))
    rows = seen.where((F.lower("action") == "connect") & c("process").isNull() & c("last").isNotNull() & far.isNotNull())
    return rows.select(
        "investigation_id",
        "event_id",
        "timestamp",
        F.col("source_name").alias("source"),
        F.lit("CONNECTED_TO").alias("relationship_type"),
        F.lit("Process").alias("src_type"),
        F.col("last.process").alias("src_key"),
        F.when(c("destination_host").isNotNull(), c("destination_type_of")).otherwise("IP").alias("dst_type"),
        far.alias("dst_key"),
        F.array("last.event_id", "event_id").alias("event_ids"),
        F.lit(True).alias("derived"),
        F.array(F.lit("shared_host"), F.lit("temporal_proximity"), F.lit("compatible_sequence")).alias("correlation_signals"),
    )


def all_observations(events: DataFrame, roles: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    direct = observations(events, roles, rules)
    return direct.unionByName(derived_edges(events, roles, rules)) if rules.derive_process_edges else direct


def relationships(seen: DataFrame) -> DataFrame:
    """Merged edges: all supporting events, first and last time, and how often. The observations remain the multigraph."""
    keys = ["investigation_id", "relationship_type", "src_type", "src_key", "dst_type", "dst_key"]
    return seen.groupBy(*keys).agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_ids")))).alias("event_ids"),
        F.min("derived").alias("derived"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("correlation_signals")))).alias("correlation_signals"),
    )
