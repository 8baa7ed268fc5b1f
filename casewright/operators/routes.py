"""Routes between two entities whose hops follow one another in time.

A route's hops are observations, each no earlier than the one before. Of all routes with one number of hops only the earliest arrival matters
to what can come after, and of two labels of a node the one with more hops and no earlier arrival is dominated and goes. So the search keeps
at most one label a node and hop, where listing simple paths would keep them all.

The search meets from both ends. From the end, going back, each node gets the latest time at which it may still be left to arrive (again one
label a hop, dominated ones dropped). The forward search goes freely for the first half of the depth; from there on it keeps only labels
from which the end can still be reached in the hops that are left. Each hop is one join on the frontier, whose result is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch, written
from .graph import INV, checked_depth, edges_between

MAX_HOPS = 10


def _links(edges: DataFrame, directed: bool) -> DataFrame:
    """Observations as links in time; undirected ones lead both ways."""

    def one(a: str, b: str) -> DataFrame:
        return edges.select(INV, F.col("timestamp").alias("at"), "event_ids", "relationship_type", F.col(f"{a}_type").alias("from_type"), F.col(f"{a}_key").alias("from"), F.col(f"{b}_type").alias("to_type"), F.col(f"{b}_key").alias("to"))

    out = one("src", "dst").where("at is not null")
    return out if directed else out.unionByName(one("dst", "src").where("at is not null"))


def _best(candidates: DataFrame, side: str, order: Column, value: Column, first: bool) -> DataFrame:
    """One label a node: the earliest arrival (or latest departure), ties decided by the hop's own columns."""
    pick = F.min_by if first else F.max_by
    return candidates.groupBy(INV, F.col(f"{side}_type").alias("node_type"), F.col(side).alias("node")).agg(pick(value, order).alias("label"))


def departures(links: DataFrame, end: str, end_type: str, hops: int, scratch: Scratch) -> DataFrame:
    """``node, hops, leave``: the latest time to leave a node and still arrive at the end in so many hops, without dominated ones."""
    into = links.where((F.col("to") == end) & (F.col("to_type") == end_type)).groupBy(INV, F.col("from_type").alias("node_type"), F.col("from").alias("node")).agg(F.max("at").alias("leave"))
    level = scratch.write(into.select(INV, "node_type", "node", F.lit(1).alias("hops"), "leave"), "departures")
    levels = [level]
    for hop in range(2, hops + 1):
        near = level.select(INV, F.col("node_type").alias("to_type"), F.col("node").alias("to"), "leave")
        found = links.join(near, [INV, "to_type", "to"]).where(F.col("at") <= F.col("leave"))
        found = found.groupBy(INV, F.col("from_type").alias("node_type"), F.col("from").alias("node")).agg(F.max("at").alias("leave"))
        known = reduce(DataFrame.unionByName, levels).groupBy(INV, "node_type", "node").agg(F.max("leave").alias("known"))
        fresh = found.join(known, [INV, "node_type", "node"], "left").where(F.col("known").isNull() | (F.col("leave") > F.col("known")))
        level = scratch.write(fresh.select(INV, "node_type", "node", F.lit(hop).alias("hops"), "leave"), "departures")
        levels.append(level)
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def routes(
    edges: DataFrame,
    start: str,
    start_type: str,
    end: str,
    end_type: str,
    depth: int = MAX_HOPS,
    investigation_id: str | None = None,
    since: str | None = None,
    until: str | None = None,
    relationship_types: list[str] | None = None,
    directed: bool = True,
    max_depth: int = MAX_HOPS,
) -> DataFrame:
    """The routes from one entity to another that no other route beats in both hops and arrival, in each investigation.

    ``hops, leaves, arrives, nodes, relationships, times, evidence`` (the event ids of each hop). A route takes, of the hops of the earliest arrival,
    the one with the least event ids, relationship and node, and so on back to the start. Start and end are the same: no route. A depth above
    ``max_depth`` is an error.
    """
    checked_depth(depth, max_depth)
    links = _links(edges_between(edges, investigation_id, since, until, relationship_types), directed)
    spark = edges.sparkSession
    scratch = Scratch(spark)
    half = depth // 2
    ways = departures(links, end, end_type, half, scratch) if half else None
    text = lambda a, b: F.concat_ws(":", a, b)
    label = F.struct("at", "event_ids", "relationship_type", "from_type", "from", F.col("leaves"), F.col("nodes"), F.col("relationships"), F.col("times"), F.col("evidence"))
    order = F.struct("at", "event_ids", "relationship_type", "from_type", "from")
    began = links.where((F.col("from") == start) & (F.col("from_type") == start_type))
    none = {"leaves": F.col("at"), "nodes": F.array(text(F.col("from_type"), F.col("from"))), "relationships": F.array().cast("array<string>"), "times": F.array().cast("array<timestamp>"), "evidence": F.array().cast("array<array<string>>")}
    candidates = began.withColumns(none)
    levels: list[DataFrame] = []
    for hop in range(1, depth + 1):
        candidates = candidates.where((F.col("to") != start) | (F.col("to_type") != start_type))
        best = _best(candidates, "to", order, label, True)
        grown = best.select(
            INV,
            "node_type",
            "node",
            F.lit(hop).alias("hops"),
            F.col("label.at").alias("arrives"),
            F.col("label.leaves").alias("leaves"),
            F.array_append("label.nodes", text(F.col("node_type"), F.col("node"))).alias("nodes"),
            F.array_append("label.relationships", F.col("label.relationship_type")).alias("relationships"),
            F.array_append("label.times", F.col("label.at")).alias("times"),
            F.concat("label.evidence", F.array("label.event_ids")).alias("evidence"),
        )
        if levels:
            known = reduce(DataFrame.unionByName, levels).groupBy(INV, "node_type", "node").agg(F.min("arrives").alias("known"))
            grown = grown.join(known, [INV, "node_type", "node"], "left").where(F.col("known").isNull() | (F.col("arrives") < F.col("known"))).drop("known")
        left = depth - hop
        if ways is not None and 0 < left <= half:
            # past the middle only what still leads to the end in time, or has arrived
            can = ways.where(F.col("hops") <= left).groupBy(INV, "node_type", "node").agg(F.max("leave").alias("leave"))
            there = (F.col("node") == end) & (F.col("node_type") == end_type)
            grown = grown.join(can, [INV, "node_type", "node"], "left").where(there | (F.col("leave") >= F.col("arrives"))).drop("leave")
        elif left == 0:
            grown = grown.where((F.col("node") == end) & (F.col("node_type") == end_type))
        level = scratch.write(grown, "arrivals")
        levels.append(level)
        onward = level.where((F.col("node") != end) | (F.col("node_type") != end_type))
        if left == 0 or onward.isEmpty():
            break
        near = onward.select(INV, F.col("node_type").alias("from_type"), F.col("node").alias("from"), "arrives", "leaves", "nodes", "relationships", "times", "evidence")
        candidates = links.join(near, [INV, "from_type", "from"]).where(F.col("at") >= F.col("arrives"))
    found = reduce(DataFrame.unionByName, levels).where((F.col("node") == end) & (F.col("node_type") == end_type))
    out = written(found.select(INV, "hops", "leaves", "arrives", "nodes", "relationships", "times", "evidence"), "routes")
    scratch.clear()
    return out
