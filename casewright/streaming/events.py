"""Structured Streaming forms of the same steps. Columns are those of ``security_events``.

Each step takes what ``ingest`` gives, which has its watermark already; ``delay`` sets one for streams that have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import ingest as steps
from ..operators.correlate import context_keys, identified, kinds_shared, met_first, with_keys
from ..operators.extract import with_roles
from ..schema import RULES, Rules


def ingest(raw: DataFrame, delay: str = "10 minutes", **options: object) -> DataFrame:
    """Valid events of a raw stream, with a watermark and without ids that repeat within it."""
    events = steps.security_events(steps.ingest(raw, dedupe=False, **options))
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["investigation_id", "event_id"])


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows a query's stateful steps have dropped as late, by the progress that it keeps (``spark.sql.streaming.numRecentProgressUpdates`` triggers)."""
    return sum(int(step["numRowsDroppedByWatermark"]) for progress in query.recentProgress for step in progress["stateOperators"])


def rejected(raw: DataFrame, **options: object) -> DataFrame:
    return steps.rejected_events(steps.ingest(raw, dedupe=False, **options))


def _marked(events: DataFrame, delay: str | None) -> DataFrame:
    return events if delay is None else events.withWatermark("timestamp", delay)


def shared_keys(events: DataFrame, rules: Rules = RULES, delay: str | None = None) -> DataFrame:
    """A row for each identifier that two events within the window share, by a stream-stream join; state is dropped behind the watermark.

    As in batch (``correlate.near``) earlier events stand in their time bucket and the next and later ones in their own, so that an event meets those of
    two buckets and not all that the state holds of a busy identifier.
    """
    keys = context_keys(_marked(events, delay), rules)
    bucket = F.floor(F.col("at") / (rules.window_seconds * 1_000_000))
    one = keys.select("investigation_id", "kind", "value", F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.col("event_id").alias("a"), F.col("timestamp").alias("time_a"))
    two = keys.select(F.col("investigation_id").alias("inv"), F.col("kind").alias("k"), F.col("value").alias("v"), bucket.alias("at_bucket"), F.col("event_id").alias("b"), F.col("timestamp").alias("time_b"))
    same = (F.col("investigation_id") == F.col("inv")) & (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")) & (F.col("bucket") == F.col("at_bucket"))
    return one.join(two, same & _near(rules)).select("investigation_id", "a", "b", "kind", "value", "time_a", "time_b")


def _near(rules: Rules) -> Column:
    """Whether ``b`` comes after ``a``, within the window."""
    span = F.expr(f"interval {rules.window_seconds} seconds")
    near = (F.col("time_b") >= F.col("time_a")) & (F.col("time_b") <= F.col("time_a") + span)
    return near & ((F.col("time_a") < F.col("time_b")) | (F.col("a") < F.col("b")))


def pairs(events: DataFrame, rules: Rules = RULES, delay: str | None = None) -> DataFrame:
    """Candidate pairs as in batch: ``investigation_id, a, b, at_a, time_b, kinds``, one row a pair, given as soon as both events are there.

    The identifiers go through the stream-stream join with the keys, so the first one that two events share gives the pair with all its kinds: no
    second state holds the pairs, which grow with the square of a bucket's events.
    """
    found = identified(_marked(events, delay), rules, ["timestamp"])

    def side(prefix: str, event: str, after: list[int]) -> DataFrame:
        return with_keys(found, prefix, after, rules, {"timestamp": f"time_{event}", "event_id": event}, f"key_{event}")

    both = side("x", "a", [0, 1]).join(side("y", "b", [0]), (F.col("key_a") == F.col("key_b")) & _near(rules)).where(met_first(F.col("key_b"), rules))
    return both.select(F.col("x_investigation_id").alias("investigation_id"), "a", "b", F.col("x_at").alias("at_a"), "time_b", kinds_shared().alias("kinds"))


def tumbling_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Events of each investigation, window and action; a window is emitted once the watermark has passed it."""
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    counted = _marked(events, delay).groupBy("investigation_id", w.alias("w"), "action").agg(F.count("*").alias("n"))
    return counted.select("investigation_id", F.col("w.start").alias("window_start"), "action", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", delay: str | None = None) -> DataFrame:
    """Activity of each investigation's users without a gap of that length, as in batch; events without a user have no session."""
    known = _marked(events, delay).where(F.col("user").isNotNull())
    s = known.groupBy("investigation_id", F.session_window("timestamp", gap).alias("w"), F.lower("user").alias("user_key")).agg(F.count("*").alias("n"), F.max("timestamp").alias("last_seen"))
    return s.select("investigation_id", "user_key", F.col("w.start").alias("first_seen"), "last_seen", "n")


#: The provider that ``transformWithState`` needs; its state is kept in the query's checkpoint.
STATE_CONF = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DERIVED = "investigation_id string, event_id string, timestamp timestamp, src_key string, dst_type string, dst_key string, exec_event_id string"
WAITING = "micros bigint, event_id string, executed string, far string, far_type string"
LAST = "process string, event_id string, micros bigint"


class LastExecution(StatefulProcessor):
    """Connections of a host with the execution before them, in order of event time whatever the order of arrival.

    Events wait in a list until the watermark has passed them, as none that precedes them can come after that; a timer at the earliest one wakes
    the host. What is left then is the last execution, one row, which goes when it is a window behind the watermark.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh = [(r.micros, r.event_id, r.executed, r.far, r.far_type) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(r[0] for r in fresh))
        return iter([])

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        # executions of one moment come before its connections, the one with the greatest id last, as in batch
        due = sorted((r for r in held if r[0] <= horizon), key=lambda r: (r[0], r[2] is None, r[1]))
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for micros, event_id, executed, far, far_type in due:
            if executed is not None:
                last = (executed, event_id, micros)
            if far is not None and last and micros - last[2] <= self.window:
                out.append(Row(investigation_id=key[0], event_id=event_id, timestamp=datetime.fromtimestamp(micros // 1_000_000, timezone.utc).replace(microsecond=micros % 1_000_000), src_key=last[0], dst_type=far_type, dst_key=far, exec_event_id=last[1]))
        if due:
            rest = [r for r in held if r[0] > horizon]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self._wake(min(r[0] for r in rest))
        if last and last[2] + self.window <= horizon:
            self.last.clear()
        elif last:
            self.last.update(last)
            self._wake(last[2] + self.window)
        return iter(out)


def derived_edges(events: DataFrame, rules: Rules = RULES, delay: str | None = None) -> DataFrame:
    """Process to destination, as ``extract.derived_edges``: what arrives within the delay, in whatever order, gives the batch's result.

    The session needs ``STATE_CONF``.
    """
    host = rules.identity.host(F.col("source_host"))
    used = with_roles(_marked(events, delay), rules=rules).where(F.lower("action").isin("execute", "connect") & F.col("source_host").isNotNull())
    slim = used.select(
        "investigation_id",
        host.alias("host"),
        "timestamp",
        F.unix_micros("timestamp").alias("micros"),
        "event_id",
        F.when((F.lower("action") == "execute") & F.col("process").isNotNull(), rules.identity.process(F.col("source_host"), F.col("process"))).alias("executed"),
        F.when((F.lower("action") == "connect") & F.col("process").isNull(), F.coalesce(rules.identity.host(F.col("destination_host")), F.col("destination_ip"))).alias("far"),
        F.when(F.col("destination_host").isNotNull(), F.col("destination_type_of")).otherwise(F.lit("IP")).alias("far_type"),
    )
    return slim.groupBy("investigation_id", "host").transformWithState(LastExecution(rules.window_seconds * 1_000_000), DERIVED, "append", "EventTime")


RAW = "investigation_id string, raw string, source_type string, source_name string, source_record_id string, ingested_at timestamp"


def late_marked(raw: DataFrame, delay: str = "10 minutes", parts: int = 64, **options: object) -> DataFrame:
    """A raw stream with ``late``: whether an event's time was behind the watermark when it came. Stateful steps drop such rows without a trace.

    The watermark is read where state is kept; none is. Rows are dealt by their text to ``parts``. Rows whose time can't be read aren't late.
    """
    columns = [c.split()[0] for c in RAW.split(", ")]
    timed = steps.normalize(steps.parse(raw.select(*columns)), **options).select(*columns, F.col("timestamp").alias("event_time")).withWatermark("event_time", delay)

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for rows in batches:
            yield rows[columns].assign(late=(rows["event_time"] <= passed).fillna(False).astype(bool))

    dealt = timed.withColumn("part", F.pmod(F.xxhash64("raw"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandasWithState(mark, f"{RAW}, late boolean", "n int", "append", GroupStateTimeout.NoTimeout)
