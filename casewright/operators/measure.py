"""Pipeline counts and durations, and evaluation against expected edges."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("casewright")


def pipeline_counts(validated: DataFrame, entities: DataFrame, edges: DataFrame, correlations: DataFrame) -> DataFrame:
    """metric, n: input, valid, rejected, entities, relationships and correlated links."""
    first = validated.agg(F.count("*").alias("input"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("rejected"))
    parts = [first.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in ("input", "valid", "rejected")])))]
    for name, df in (("entities", entities), ("relationships", edges), ("correlated_links", correlations.where("related"))):
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n"))
    return reduce(DataFrame.unionByName, parts)


def write_observed(df: DataFrame, path: str, name: str, metrics: dict[str, Column] | None = None) -> dict[str, float]:
    """Write ``df`` and give what was counted while it was written (``rows`` and the ``metrics``), with the seconds it took; nothing is read for it."""
    seen = Observation(name)
    began = time.monotonic()
    df.observe(seen, F.count("*").alias("rows"), *[m.alias(k) for k, m in (metrics or {}).items()]).write.option("compression", "zstd").parquet(path)
    return seen.get | {"seconds": time.monotonic() - began}


def observed_counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """metric, n of observed counts, as ``pipeline_counts`` gives them by reading."""
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "metric string, n bigint")


@contextmanager
def stage(name: str, request_id: str, investigation_id: str, durations: dict[str, float], event_id: str | None = None) -> Iterator[None]:
    """Times a stage and logs it, without any payload. ``event_id``: where the stage is about one event."""
    began, ok = time.monotonic(), False
    try:
        yield
        ok = True
    finally:
        durations[name] = time.monotonic() - began
        LOG.info(json.dumps({"request": request_id, "investigation": investigation_id, "event": event_id, "stage": name, "success": ok, "seconds": round(durations[name], 3)}))


def confusion(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """By scenario: expected, produced, correct, unsupported and missed edges, precision and recall. Both: scenario, relationship_type, src_key, dst_key."""
    keys = ["scenario", "relationship_type", "src_key", "dst_key"]
    e, p = expected.select(*keys).distinct().withColumn("e", F.lit(1)), produced.select(*keys).distinct().withColumn("p", F.lit(1))
    both = e.join(p, keys, "full")
    counts = both.groupBy("scenario").agg(
        F.count("e").alias("expected"), F.count("p").alias("produced"), F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("correct"), F.count_if(F.col("e").isNull()).alias("unsupported"), F.count_if(F.col("p").isNull()).alias("missed")
    )
    return counts.withColumn("precision", F.try_divide("correct", "produced")).withColumn("recall", F.try_divide("correct", "expected"))


#: What a comparison of reviews records; people measure it, and only measured rows are reported.
UTILITY = "scenario string, participant string, assisted boolean, seconds double, pivots int, sources_checked int, events_inspected int, completed boolean, errors int"
UTILITY_MEASURES = ["seconds", "pivots", "sources_checked", "events_inspected", "errors"]


def utility(rows: DataFrame) -> DataFrame:
    """By scenario and whether the review was assisted: reviews, how many were completed, and the mean of each measure over the completed ones."""
    return rows.groupBy("scenario", "assisted").agg(F.count("*").alias("reviews"), F.count_if("completed").alias("completed"), *[F.avg(F.when(F.col("completed"), F.col(c))).alias(f"mean_{c}") for c in UTILITY_MEASURES])
