"""Graph reads: filters, neighbours, bounded traversal, paths and the named pivots. Edges are relationship observations.

Every read stays within investigations: a node is (investigation, entity type, key), and no step leads from one investigation
to another. Where no investigation is named, the answer holds those of all of them side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .cases import EngineError

MAX_DEPTH, DEFAULT_LIMIT = 5, 500
INV = "investigation_id"
#: name: (relationship types, type of the start, type of the end, whether the start is the edge's source)
PIVOTS = {
    "host_users": (["LOGGED_INTO", "AUTHENTICATED_TO"], "Host", "User", False),
    "host_processes": (["EXECUTED"], "Host", "Process", True),
    "host_destinations": (["CONNECTED_TO"], "Host", None, True),
    "server_users": (["LOGGED_INTO", "AUTHENTICATED_TO"], "Server", "User", False),
    "user_hosts": (["LOGGED_INTO", "AUTHENTICATED_TO"], "User", None, True),
    "process_destinations": (["CONNECTED_TO"], "Process", None, True),
    "server_files": (["ACCESSED"], "Server", "File", True),
}


def checked_depth(depth: int, most: int) -> int:
    if not 1 <= depth <= most:
        raise EngineError(400, f"depth must be between 1 and {most}")
    return depth


def edges_between(edges: DataFrame, investigation_id: str | None = None, start: str | None = None, end: str | None = None, relationship_types: list[str] | None = None, entity_types: list[str] | None = None) -> DataFrame:
    """Filtered edges; over a written table all conditions reach the scan. Times are inclusive UTC texts."""
    tests = []
    if investigation_id is not None:
        tests.append(F.col(INV) == investigation_id)
    if start is not None:
        tests.append(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if relationship_types:
        tests.append(F.col("relationship_type").isin(relationship_types))
    if entity_types:
        tests.append(F.col("src_type").isin(entity_types) & F.col("dst_type").isin(entity_types))
    return edges.where(reduce(lambda a, b: a & b, tests)) if tests else edges


def bounded(edges: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first edges by time, under a total order."""
    return edges.orderBy("timestamp", "relationship_type", "src_key", "dst_key", "event_id").limit(limit)


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node, node_type, neighbour, neighbour_type, forward."""
    keep = [INV, "relationship_type", "timestamp", "event_id", "event_ids"]
    out = edges.select(*keep, F.col("src_key").alias("node"), F.col("src_type").alias("node_type"), F.col("dst_key").alias("neighbour"), F.col("dst_type").alias("neighbour_type"), F.lit(True).alias("forward"))
    back = edges.select(*keep, F.col("dst_key").alias("node"), F.col("dst_type").alias("node_type"), F.col("src_key").alias("neighbour"), F.col("src_type").alias("neighbour_type"), F.lit(False).alias("forward"))
    return out.unionByName(back)


def neighbours(edges: DataFrame, node: str, investigation_id: str | None = None, node_type: str | None = None, start: str | None = None, end: str | None = None, relationship_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Edges at a node in either direction, in time order."""
    found = edges_between(edges, investigation_id, start, end, relationship_types)
    found = undirected(found.where((F.col("src_key") == node) | (F.col("dst_key") == node))).where(F.col("node") == node)
    if node_type is not None:
        found = found.where(F.col("node_type") == node_type)
    found = found.orderBy("timestamp", INV, "event_id", "relationship_type", "neighbour")
    return found if limit is None else found.limit(limit)


def around(edges: DataFrame, node: str, anchor: str, minutes: int = 15, investigation_id: str | None = None) -> DataFrame:
    """Neighbours within minutes of an anchor time."""
    at = F.lit(anchor).cast("timestamp")
    span = F.make_dt_interval(mins=F.lit(minutes))
    return neighbours(edges.where((F.col("timestamp") >= at - span) & (F.col("timestamp") <= at + span)), node, investigation_id)


def _starts(edges: DataFrame, node: str, node_type: str | None) -> DataFrame:
    """The nodes of that key in each investigation that has them."""
    ends = [edges.select(INV, F.col(f"{side}_type").alias("node_type"), F.col(f"{side}_key").alias("node")).where(F.col("node") == node) for side in ("src", "dst")]
    found = ends[0].unionByName(ends[1]).distinct()
    return found if node_type is None else found.where(F.col("node_type") == node_type)


def hops(
    edges: DataFrame,
    node: str,
    depth: int = 1,
    investigation_id: str | None = None,
    node_type: str | None = None,
    start: str | None = None,
    end: str | None = None,
    relationship_types: list[str] | None = None,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """The evidence of a traversal: each observation that leads from a node of hop ``n - 1`` to one first reached at hop ``n``, in either direction.

    One join for each hop, on the frontier alone, whose result is written; filters apply to all hops. A depth above ``max_depth`` is an error.
    """
    checked_depth(depth, max_depth)
    near = undirected(edges_between(edges, investigation_id, start, end, relationship_types))
    key = [INV, "node_type", "node"]
    seen = frontier = _starts(edges_between(edges, investigation_id, start, end, relationship_types), node, node_type)
    levels = []
    for hop in range(1, depth + 1):
        step = near.join(frontier, key, "left_semi")
        fresh = step.join(seen.select(F.col(INV), F.col("node_type").alias("neighbour_type"), F.col("node").alias("neighbour")), [INV, "neighbour_type", "neighbour"], "left_anti")
        fresh = written(fresh, "hop")
        levels.append(fresh.withColumn("hop", F.lit(hop)))
        frontier = fresh.select(INV, F.col("neighbour_type").alias("node_type"), F.col("neighbour").alias("node")).distinct()
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, node: str, depth: int = 1, entity_types: list[str] | None = None, limit: int | None = None, **filters: object) -> DataFrame:
    """Nodes within ``depth`` hops with their least hop (1 is direct), and the event ids of the observations that reach them there.

    ``filters``: investigation_id, node_type, start, end, relationship_types and max_depth, as for ``hops``. ``entity_types`` selects from the result.
    """
    found = hops(edges, node, depth, **filters).groupBy(INV, F.col("neighbour").alias("node"), F.col("neighbour_type").alias("node_type"), "hop")
    out = found.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_ids")))).alias("event_ids"))
    if entity_types:
        out = out.where(F.col("node_type").isin(entity_types))
    return out if limit is None else out.orderBy("hop", INV, "node_type", "node").limit(limit)


def paths(
    edges: DataFrame,
    start: str,
    depth: int = MAX_DEPTH,
    end: str | None = None,
    investigation_id: str | None = None,
    node_type: str | None = None,
    relationship_types: list[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Directed simple paths from ``start`` within each investigation: nodes, the relationship and the evidence of each hop. Longer paths than ``max_depth`` are to be asked for."""
    checked_depth(depth, max_depth)
    used = edges_between(edges, investigation_id, since, until, relationship_types)
    named = lambda side: F.concat_ws(":", F.col(f"{side}_type"), F.col(f"{side}_key"))
    step = used.groupBy(INV, named("src").alias("from"), named("dst").alias("to"), F.col("dst_key"), "relationship_type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_ids")))).alias("ids"))
    first = _starts(used, start, node_type)
    now = first.select(INV, F.concat_ws(":", "node_type", "node").alias("last"), F.array(F.concat_ws(":", "node_type", "node")).alias("seen"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("relationships"), F.array().cast("array<array<string>>").alias("evidence"))
    levels = []
    for _ in range(depth):
        grown = now.join(step, (now[INV] == step[INV]) & (F.col("last") == F.col("from"))).where(~F.array_contains("seen", F.col("to")))
        now = grown.select(
            now[INV], F.col("to").alias("last"), F.array_append("seen", F.col("to")).alias("seen"), F.array_append("nodes", F.col("dst_key")).alias("nodes"),
            F.array_append("relationships", F.col("relationship_type")).alias("relationships"), F.concat("evidence", F.array("ids")).alias("evidence"),
        )
        now = written(now, "paths")
        levels.append(now)
    out = reduce(DataFrame.unionByName, levels)
    out = out if end is None else out.where(F.element_at("nodes", -1) == end)
    return out.select(INV, F.array_join("nodes", " > ").alias("path"), "relationships", (F.size("nodes") - 1).alias("hops"), "evidence")


def pivot(edges: DataFrame, name: str, start: str | None = None, **filters: object) -> DataFrame:
    """A named pivot over all starts, or one: start, end, how many observations join them and their first and last time. ``filters``: as for ``edges_between``."""
    kinds, start_type, end_type, forward = PIVOTS[name]
    a, b = ("src", "dst") if forward else ("dst", "src")
    found = edges_between(edges, **filters).where(F.col("relationship_type").isin(kinds) & (F.col(f"{a}_type") == start_type))
    if end_type:
        found = found.where(F.col(f"{b}_type") == end_type)
    if start is not None:
        found = found.where(F.col(f"{a}_key") == start)
    return found.groupBy(INV, F.col(f"{a}_key").alias("start_key"), F.col(f"{b}_type").alias("end_type"), F.col(f"{b}_key").alias("end_key")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def counts(edges: DataFrame) -> DataFrame:
    """Distinct edges and events of each investigation and relationship type."""
    ends = ["src_type", "src_key", "dst_type", "dst_key"]
    return edges.groupBy(INV, "relationship_type").agg(F.count_distinct(*ends).alias("n_edges"), F.count_distinct("event_id").alias("n_events"))


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two entity tables as one, nothing lost."""
    keys = [INV, "entity_type", "entity_key"]
    both = old.unionByName(new, allowMissingColumns=True)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("event_ids"))))
    return both.groupBy(*keys).agg(F.min_by("name", "first_seen").alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.size(ids).cast("bigint").alias("n_events"), ids.alias("event_ids"))


def entity_detail(entities: DataFrame, edges: DataFrame, investigation_id: str | None = None, key: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Entities with the number of their neighbours and of their observations of each relationship type."""
    tests: list[Column] = [F.col(c) == v for c, v in ((INV, investigation_id), ("entity_key", key), ("entity_type", entity_type)) if v is not None]
    asked = entities.where(reduce(lambda a, b: a & b, tests)) if tests else entities
    ends = undirected(edges).select(INV, F.col("node_type").alias("entity_type"), F.col("node").alias("entity_key"), "neighbour_type", "neighbour", "relationship_type")
    each = ends.groupBy(INV, "entity_type", "entity_key", "relationship_type").agg(F.count("*").alias("n"))
    kinds = each.groupBy(INV, "entity_type", "entity_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship_type", "n")))).alias("observations"))
    near = ends.groupBy(INV, "entity_type", "entity_key").agg(F.count_distinct("neighbour_type", "neighbour").alias("n_neighbours"))
    on = [INV, "entity_type", "entity_key"]
    return asked.join(near, on, "left").join(kinds, on, "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0)))
