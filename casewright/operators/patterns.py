"""Patterns of events over time, matched by an automaton that runs through each entity's events.

A pattern is a sequence of steps over the events of one entity (a user, a host, a file ...) in order of time, then event id. Each step has a
condition, the most seconds since the event of the step before, how often it repeats (each repetition is an event of its own), and what
must not happen between the step before and its own event. The pattern as a whole may have a most length.

Matching is "next match": each event that satisfies the first step begins one match, and each further step takes the next event that
satisfies it. So an entity has at most as many matches as events, and all of them are found; there are no nested joins.

The automaton runs backwards: going through an entity's events from the last to the first it keeps, for each step, the rest of the match
that would follow (and for each exclusion the next event that breaks it). An event that satisfies a step takes the next step's rest as
its own continuation, if that is near enough and nothing excluded lies between. In Spark terms each step is one window function over
a growing frame, all over the same partitioning and order: one shuffle and one sort for a pattern, and linear work.

Busy entities are spread over buckets of time as long as a match can be. An event stands in its own bucket and, as what may follow, in the
one before; matches begin in their own bucket alone.

Defined results: events without the entity or without a time take part in no match; conditions that are null are not satisfied; repeated rows of one event id
are events of one moment, ordered by id, and a match never takes two events with one (time, id); no events, no matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RULES, Rules
from .correlate import context_keys


@dataclass(frozen=True)
class Step:
    """One step; conditions are SQL over the events' columns. ``within``: seconds since the step before (and between repetitions)."""

    name: str
    when: str
    within: int = 600
    times: int = 1
    unless: str | None = None


@dataclass(frozen=True)
class Pattern:
    """``by``: the kind of entity (``user``, ``host``, ``ip``, ``file``, ``process``). ``most``: seconds from the first event to the last."""

    name: str
    by: str
    steps: tuple[Step, ...]
    most: int | None = None

    def states(self) -> list[Step]:
        """The automaton's states: repetitions are states of their own. An exclusion holds before the first of them."""
        if not self.steps or any(s.times < 1 or s.within < 0 for s in self.steps):
            raise ValueError("a pattern has steps, which occur once or more within no less than 0 seconds")
        return [Step(s.name, s.when, s.within, 1, s.unless if k == 0 else None) for s in self.steps for k in range(s.times)]

    def span(self) -> int:
        """The most seconds that a match can take."""
        reach = sum(s.within for s in self.states()[1:])
        return reach if self.most is None else min(reach, self.most)


def matches(events: DataFrame, pattern: Pattern, rules: Rules = RULES) -> DataFrame:
    """``investigation_id, pattern, entity_key, first_seen, last_seen, steps, event_ids``: a row for each match; ``steps`` names the step of each event."""
    states = pattern.states()
    tests = [F.coalesce(F.expr(s.when), F.lit(False)) for s in states]
    breaks = [F.coalesce(F.expr(s.unless), F.lit(False)) if s.unless else None for s in states]
    marked = events.where(F.col("timestamp").isNotNull()).withColumns({f"__is{k}": t for k, t in enumerate(tests)} | {f"__no{k}": b for k, b in enumerate(breaks) if b is not None})
    flags = [f"__is{k}" for k in range(len(states))] + [f"__no{k}" for k, b in enumerate(breaks) if b is not None]
    # only events that some step or exclusion looks at
    used = marked.where(F.exists(F.array(*flags), lambda x: x))
    keyed = context_keys(used, rules, keep=flags).where(F.col("kind") == pattern.by)
    span = max(pattern.span(), 1) * 1_000_000
    bucket = F.floor(F.col("at") / span)
    keyed = keyed.withColumn("own", bucket).withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    here = F.struct("at", "event_id")
    onward = Window.partitionBy("investigation_id", "value", "bucket").orderBy(F.desc("at"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)

    def following(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(onward)

    # what follows an event of the last state is nothing; rests are built from there to the first state
    alone = F.when(F.col(f"__is{len(states) - 1}"), F.struct(here.alias("first"), F.array(F.col("event_id")).alias("ids"), F.col("at").alias("end")))
    out = keyed.withColumn(f"__m{len(states) - 1}", alone)
    for k in range(len(states) - 2, -1, -1):
        step = states[k + 1]
        # the next event of the step decides, also where it has no rest: a later one is never taken instead
        out = out.withColumn("__at", following(F.when(F.col(f"__is{k + 1}"), F.struct(here.alias("first"), F.col(f"__m{k + 1}").alias("rest")))))
        near = F.col("__at.rest").isNotNull() & (F.col("__at.first.at") - F.col("at") <= step.within * 1_000_000)
        if step.unless:
            out = out.withColumn("__broken", following(F.when(F.col(f"__no{k + 1}"), here)))
            near = near & (F.col("__broken").isNull() | (F.col("__broken") >= F.col("__at.first")))
        grown = F.struct(here.alias("first"), F.concat(F.array(F.col("event_id")), F.col("__at.rest.ids")).alias("ids"), F.col("__at.rest.end").alias("end"))
        out = out.withColumn(f"__m{k}", F.when(F.col(f"__is{k}") & near, grown))
    found = out.where(F.col("__m0").isNotNull() & (F.col("bucket") == F.col("own")))
    if pattern.most is not None:
        found = found.where(F.col("__m0.end") - F.col("at") <= pattern.most * 1_000_000)
    return found.select(
        "investigation_id",
        F.lit(pattern.name).alias("pattern"),
        F.col("value").alias("entity_key"),
        F.timestamp_micros("at").alias("first_seen"),
        F.timestamp_micros("__m0.end").alias("last_seen"),
        F.array(*[F.lit(s.name) for s in states]).alias("steps"),
        F.col("__m0.ids").alias("event_ids"),
    )
